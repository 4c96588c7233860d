"""Session construction and lineage cutting.

The cluster names the shared checkpoint folder in ``spark.checkpoint.dir``;
we only fill it in when it is unset (local tests).
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings a job needs at any scale; everything else stays the cluster's.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, app: str = "kairos",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it.

    Matters where it is used from a path of the driver's own making, as in
    tests; on a cluster the package is installed or sent along with the job.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, root])


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only if none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master.startswith("local"):
            configured = tempfile.mkdtemp(prefix="kairos-ckpt-")
        else:
            raise RuntimeError("spark.checkpoint.dir is not set on this cluster")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: Spark removes them when a write ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later plans start from a scan, and lost executors cost no lineage.

    A ``path`` of the caller's own is written over, for tables that are done with when the next one comes.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with swept(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MAX_ROUNDS = 256


def in_rounds(rows: DataFrame, key: str, per_round: int, result: Callable[[Callable[[DataFrame], DataFrame]], DataFrame],
              name: str = "rounds") -> DataFrame:
    """``result`` for one slice of the keys after another, as one table; for results much smaller than what they are made of.

    ``result`` gets a function that cuts any table with the column ``key`` to
    the slice, and has to need nothing of other slices. Shuffles of a slice
    are removed before the next, so the disk holds those of some ``per_round``
    of ``rows`` at a time; beyond MAX_ROUNDS slices they get larger instead
    of more, since each reads the other tables again. A null key is a key.
    """
    spark = rows.sparkSession
    with swept(spark):
        n = max(1, min(MAX_ROUNDS, -(-rows.count() // per_round)))
    path = new_path(spark, name)
    for i in range(n):
        df = result(lambda t: t.where(F.pmod(F.xxhash64(key), F.lit(n)) == i))  # noqa: B023
        with swept(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Plans with these hold data or code that their text does not show.
_OPAQUE = re.compile(r"LocalRelation|LogicalRDD|ExternalRDD|UDF|InPandas|InArrow|Python|rand\(|uuid\(|current_timestamp|current_date|now\(|StreamingRelation")


def fingerprint(df: DataFrame) -> str | None:
    """What a table would be made of: its plan and the name, size and time of every input file; None if the plan doesn't tell.

    Ids in the plan's text are numbered by first appearance, so that the same
    query written twice has one fingerprint. Input files are listed and
    hashed by Spark; their content is not read.
    """
    spark = df.sparkSession
    width = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(width, None)
    spark.conf.set(width, "100000")
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset(width) if before is None else spark.conf.set(width, before)
    if _OPAQUE.search(plan):
        return None
    seen: dict[str, str] = {}
    # expression ids, and the numbered names of lambda arguments
    plan = re.sub(r"(?:(?<=#)\d+L?)|\b[xyz]_\d+", lambda m: seen.setdefault(m.group(0).rstrip("L"), f"i{len(seen)}"), plan)
    files = sorted(df.inputFiles())
    listed = None
    if files:
        f = spark.read.format("binaryFile").load([*files]).select("path", "modificationTime", "length")
        listed = f.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{plan}|{files}|{listed}".encode()).hexdigest()


def build_once(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, written only if no finished one has its fingerprint.

    Changed input files or another query give another fingerprint, so a table
    is never older than what it is made of. ``root`` may name a folder that
    outlives the session. Where there is no fingerprint, the table is written
    each time.
    """
    key = fingerprint(df)
    if key is None:
        return cut_lineage(df, name)
    spark = df.sparkSession
    path = f"{root or checkpoint_dir(spark) + '/once'}/{name}-{key[:40]}"
    try:
        done = not spark.read.parquet(f"{path}.done").isEmpty()
    except AnalysisException:
        done = False
    if not done:
        with swept(spark):
            df.write.mode("overwrite").parquet(path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}.done")  # after the table: a lost driver leaves no mark
    return spark.read.schema(df.schema).parquet(path)
