"""Writers (S5, S7, S14): partitioned files in place of one big JSON dump."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYOUTS = {"by_client": ["client_id"], "by_date": ["cutoff"], "flat": []}


def write_examples(df: DataFrame, path: str, layout: str = "by_client", fmt: str = "json",
                   mode: str = "overwrite", max_records: int = 100_000) -> None:
    """One folder per client or date, as many files in it as its rows need.

    Tasks write to the folders of the rows they hold, without a shuffle by
    folder: a client with a third of all rows is not one task's work.
    """
    w = df.write.mode(mode).format(fmt).option("maxRecordsPerFile", max_records)
    if LAYOUTS[layout]:
        w = w.partitionBy(*LAYOUTS[layout])
    w.save(path)


def write_keyed_json(df: DataFrame, path: str, key: str, order: str, files: int, mode: str = "overwrite") -> None:
    """``files`` JSON objects that hold, under each value of ``key``, the list of its rows (without the key) by ``order``.

    Rows go to files by a hash of ``order``, so a key with a third of all rows
    is spread over all files; a file is sorted once and written line by line,
    never put together as one value. A null key is written as ``null``, as a
    text. No rows, no files.
    """
    rest = [c for c in df.columns if c != key]
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_key"), F.col(order).alias("_order"),
                     F.pmod(F.xxhash64(order), F.lit(files)).alias("_file"),
                     F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("_row"))
    place = Window.partitionBy("_file").orderBy("_key", "_order", "_row")
    before, after = F.lag("_key").over(place), F.lead("_key").over(place)
    name = F.regexp_extract(F.to_json(F.array("_key")), r"(?s)^\[(.*)\]$", 1)
    opening = F.when(before.isNull(), F.concat(F.lit("{"), name, F.lit(": ["))).when(
        before != F.col("_key"), F.concat(name, F.lit(": ["))).otherwise("")
    closing = F.when(after.isNull(), "]}").when(after != F.col("_key"), "],").otherwise(",")
    rows.select("_file", F.concat(opening, "_row", closing).alias("value")).write.mode(mode).partitionBy("_file").text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_responses(df: DataFrame, path: str, mode: str = "append") -> None:
    """Stored responses, one folder per model and data variant."""
    df.write.mode(mode).partitionBy("model", "data_variant").json(path)


def _finished(spark: SparkSession, path: str) -> bool:
    """True if ``materialize_or_load`` has marked ``path`` as completely written."""
    try:
        return not spark.read.parquet(f"{path}.done").isEmpty()
    except AnalysisException:
        return False


def materialize_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                        fmt: str = "parquet") -> DataFrame:
    """Build once into ``path`` (a shared folder), then always read it back.

    Writing a table is also how long lineages are cut: the result survives
    executor loss and later stages start from the files. A marker written
    after the table tells a finished one from what a lost driver left.
    """
    if not _finished(spark, path):
        build().write.mode("overwrite").format(fmt).save(path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}.done")
    return spark.read.format(fmt).load(path)


def save_split(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)
