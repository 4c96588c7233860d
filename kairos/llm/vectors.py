"""What the vector searches share: usable vectors, equal vectors as one, moments, final ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.llm.common import materialize, pick


def usable(rows: DataFrame, convert=None) -> DataFrame:
    """``vec_id`` and ``vec`` (doubles) of the rows that take part, one per id.

    Left out: null ids, null or empty vectors, vectors with null or non-finite
    components. Rows that share an id are one: the smallest vector.
    """
    v = pick(rows, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0)).where(~bad)
    if convert is not None:
        v = v.select("vec_id", convert(F.col("vec")).alias("vec"))
    return v.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """``gid``, ``vec``, ``ids``: equal vectors as one, with their ``keep`` smallest ids (``gid``: the smallest).

    Copies beyond ``keep`` can't be among a query's best ``keep`` - 1, as ties go to smaller ids.
    """
    place = Window.partitionBy("vec").orderBy("vec_id")  # a limit on the row number is applied before the shuffle too
    least = vectors.withColumn("place", F.row_number().over(place)).where(F.col("place") <= keep)
    return least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("gid"), "vec", "ids")


def moments(vecs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and second moments of ``vec``: sums per partition, added up by Spark; the result has a size set by the dimension."""
    def work(batches):
        n, total = 0, None
        for b in batches:
            x = matrix(b["vec"])
            full = np.hstack([np.ones((len(x), 1)), x])
            part = full.T @ full
            if total is None or len(part) > len(total):
                grown = np.zeros_like(part)
                if total is not None:
                    grown[:len(total), :len(total)] = total
                total = grown
            total[:len(part), :len(part)] += part
            n += len(x)
        if n:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})
    sums = vecs.select("vec").mapInPandas(work, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if not len(sums):
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(sums["i"].max()) + 1
    out = np.zeros((d, d))
    out[sums["i"], sums["j"]] = sums["s"]
    return int(round(out[0, 0])), out[0, 1:] / out[0, 0], out[1:, 1:] / out[0, 0]


def matrix(vecs: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    rows = [np.asarray(v, np.float64) for v in vecs]
    width = max([len(r) for r in rows], default=0) if width is None else width
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def ranked(best: DataFrame, members: DataFrame, order: Column, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``.

    ``best``: ``gid`` (a query vector), ``score``, ``ids`` of distinct
    candidates. ``members``: ``query_id``, ``gid``. A list of k + 1 rows per
    query vector goes to each of its ids, which drops itself; no group of
    equal queries is gathered.
    """
    rows = best.select("gid", "score", F.explode("ids").alias("vec_id"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("gid").orderBy(order, "vec_id"))).where(F.col("place") <= k + 1)
    lists = rows.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    own = members.join(lists, "gid").select("query_id", F.slice(F.filter(
        "found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def members_of(vectors: DataFrame, groups: DataFrame, every: int) -> DataFrame:
    """``query_id`` and ``gid`` of the vectors whose id is divisible by ``every``."""
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec")
    return materialize(queries.join(groups.select("gid", "vec"), "vec").select("query_id", "gid"), "members")
