"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.session import checkpoint_dir, let_workers_import

WORD_GAP = r"\x20\x09-\x0D"  # the ASCII blanks that separate words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name.

    Extra columns may clash in any way (same name twice, same name in another
    case): every column gets a positional name first, and the first exact
    match wins.
    """
    let_workers_import(df.sparkSession)
    temp = [f"c{i}" for i in range(len(df.columns))]
    flat = df.toDF(*temp)
    return flat.select([F.col(temp[df.columns.index(n)]).alias(n) for n in names])


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows starts from a table that survives lost
    executors. The folder is the one the cluster names in
    ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
