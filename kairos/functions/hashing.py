"""Portable randomness.

A draw is a pure function of (seed, key...): md5 of the '|'-joined text.
DuckDB computes the same md5, so every sampled operator has an exact SQL
oracle; ``sql_hash`` / ``sql_uniform`` emit the matching SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2 ** 52)


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed, *keys) -> Column:
    """32 hex chars; sorting by it is a seeded permutation of the keys."""
    parts = [F.lit(str(seed))] + [_as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def uniform(seed, *keys) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of the md5."""
    h = hash_key(seed, *keys)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(_TWO_52)


def hash_bucket(seed, n: int, *keys) -> Column:
    """Integer in [0, n) from the md5; used to pick one of n shared permutations."""
    h = hash_key(seed, *keys)
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") % F.lit(n)).cast("int")


def sql_hash(seed, *exprs: str) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"md5(concat_ws('|', {inner}))"


def sql_uniform(seed, *exprs: str) -> str:
    return f"(('0x' || substr({sql_hash(seed, *exprs)}, 1, 13))::BIGINT / 4503599627370496.0)"


def sql_bucket(seed, n: int, *exprs: str) -> str:
    return f"CAST((('0x' || substr({sql_hash(seed, *exprs)}, 1, 13))::BIGINT % {n}) AS INTEGER)"
