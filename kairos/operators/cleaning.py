"""Cleaning and projection operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, order: str = "_ingest_seq") -> DataFrame:
    """First row per key in load order.

    Written as ``min_by`` over a struct instead of a row_number window: the
    aggregate combines map-side, so a key holding a third of all rows never
    lands whole in one task. Rows with a null key are dropped (P4).
    """
    others = [c for c in df.columns if c != key]
    picked = F.min_by(F.struct(*others), F.struct(F.col(order), *[F.col(c) for c in others]))
    return (df.where(F.col(key).isNotNull())
            .groupBy(key).agg(picked.alias("_r")).select(key, "_r.*"))


def strip_token(df: DataFrame, columns, token: str = "Predicted_") -> DataFrame:
    """Remove ``token`` everywhere in each listed column (P3); nulls pass."""
    return df.withColumns({c: F.replace(F.col(c), F.lit(token), F.lit("")) for c in columns})


def transaction_class(type_col) -> "F.Column":
    """'Buy' -> BuyTransaction, anything else (null too) -> SellTransaction (P10)."""
    c = F.col(type_col) if isinstance(type_col, str) else type_col
    return F.when(c == "Buy", "BuyTransaction").otherwise("SellTransaction")


def format_instruction_dataset(df: DataFrame) -> DataFrame:
    """Drop ``instruction``, rename output->response and input->instruction."""
    return df.drop("instruction").withColumnsRenamed({"output": "response", "input": "instruction"})


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct columns to ``a.b`` top-level columns."""
    from pyspark.sql import types as T

    def walk(schema, prefix):
        out = []
        for f in schema.fields:
            name = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, name + ".")
            else:
                out.append(name)
        return out

    paths = walk(df.schema, "")
    return df.select([F.col("`" + p.split(".")[0] + "`" + "".join(f".`{q}`" for q in p.split(".")[1:]))
                      .alias(p.replace(".", sep)) for p in paths])
