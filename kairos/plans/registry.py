"""Registry of report queries: each pairs a Spark builder with its DuckDB oracle.

``report`` puts a result into a comparison-friendly shape: dates and
timestamps as ISO text, doubles rounded to 6 places. The oracle SQL applies
the same rules (``rnd`` / ``dtxt`` below).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, lambda spark, sf_dir: report(fn(spark, sf_dir)), sql)
        return fn
    return deco


def report(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(cols)


def rnd(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def dtxt(expr: str) -> str:
    return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d')"


def ttxt(expr: str) -> str:
    return f"strftime(CAST({expr} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
