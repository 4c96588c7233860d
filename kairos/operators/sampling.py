"""Exact, reproducible per-group sampling.

Rows are ordered inside their group by the md5 text of (seed, key...). A
literal k is a window-group limit, which Spark applies before the shuffle. For
a k that depends on the group's size, the k first rows are found without
sorting any whole group:

1. the first three hex digits of the hash give one of 4096 buckets; a
   histogram per (group, bucket) is combined map-side;
2. per group, the running count over buckets (at most 4096 rows) locates the
   bucket holding the k-th row;
3. rows in earlier buckets are kept outright; only the boundary bucket
   (about n/4096 rows of a group, since the hash is uniform) is ranked. The
   rows are joined with one row per group, never with the histogram.

So a group holding a third of all rows costs one small ranking, and k may be
any expression of the group size n (``floor(n/5)``, ``ceil(n/10)``, ...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.functions.hashing import hash_key

BUCKET_DIGITS = 3


def with_order_key(df: DataFrame, seed, *keys, name: str = "_h") -> DataFrame:
    """Add the md5 order key; rows sorted by it are a seeded permutation."""
    return df.withColumn(name, hash_key(seed, *keys))


def first_k_per_group(df: DataFrame, group_cols: list[str], order_col: str,
                      k: int | Callable[[Column], Column], rank_col: str | None = None) -> DataFrame:
    """Rows whose rank by ``order_col`` (md5 text) inside their group is <= k.

    ``k`` is an int or a function of the group size column. With ``rank_col``
    the exact 1-based rank is returned as well (ranks are computed only for
    kept rows: earlier buckets are ranked inside their own bucket and offset).
    """
    g = list(group_cols)
    if isinstance(k, int):
        # a literal k is a window-group limit: every task cuts its groups to k rows before the shuffle
        name = rank_col or "_r"
        top = df.withColumn(name, F.row_number().over(Window.partitionBy(*g).orderBy(order_col)).cast("long")).where(F.col(name) <= k)
        return top if rank_col else top.drop(name)
    if rank_col is None:
        return marked_first_k(df, g, order_col, k).where("_in").drop("_in")
    x = df.withColumn("_b", _bucket(order_col))
    hist = _running(x, g, k).where(F.col("_before") < F.col("_k"))
    # only rows of buckets that the first k reach into go through the shuffles of the join and the ranking
    x = x.join(F.broadcast(hist.groupBy(*g).agg(F.max("_b").alias("_edge"))), g, "left").where(F.col("_b") <= F.coalesce("_edge", F.lit(-1)))
    wr = Window.partitionBy(*g, "_b").orderBy(order_col)
    out = x.drop("_edge").withColumn("_r", F.row_number().over(wr)).join(hist.select(*g, "_b", "_before", "_k").hint("merge"), [*g, "_b"])
    out = out.where(F.col("_before") + F.col("_r") <= F.col("_k"))
    return out.withColumn(rank_col, (F.col("_before") + F.col("_r")).cast("long")).drop("_b", "_before", "_k", "_r")


def _bucket(order_col: str) -> Column:
    return F.conv(F.substring(F.col(order_col), 1, BUCKET_DIGITS), 16, 10).cast("int")


def _running(x: DataFrame, g: list[str], k: Callable[[Column], Column]) -> DataFrame:
    """(group, _b, _c, _before, _k): rows of each bucket and before it, and the group's k."""
    wg = Window.partitionBy(*g)
    wc = wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = x.groupBy(*g, "_b").agg(F.count("*").alias("_c"))
    return (hist.withColumn("_n", F.sum("_c").over(wg)).withColumn("_before", F.sum("_c").over(wc) - F.col("_c"))
            .withColumn("_k", k(F.col("_n")).cast("long")).drop("_n"))


def marked_first_k(df: DataFrame, group_cols: list[str], order_col: str, k: Callable[[Column], Column], mark: str = "_in") -> DataFrame:
    """All rows, with ``mark`` true for the first k of each group; rows of a null group are never marked.

    The rows meet one row per group: the last bucket that the first k reach
    into; that table is broadcast, so groups have to be few enough for it. It
    is never the rows, which Spark takes, after an explode, for as few as
    there were before it, and which stay where they are.
    """
    g = list(group_cols)
    x = df.withColumn("_b", _bucket(order_col))
    last = F.max(F.when(F.col("_before") < F.col("_k"), F.struct("_b", "_before", "_k")))
    cut = _running(x, g, k).groupBy(*g).agg(last.alias("_cut")).where("_cut IS NOT NULL").select(*g, "_cut.*").withColumnsRenamed(
        {"_b": "_edge"})
    # the comparison reads both sides, or the join would turn into an inner one
    x = x.join(F.broadcast(cut), g, "left").withColumn("_side", F.signum(F.col("_b") - F.coalesce("_edge", F.lit(-1))))
    edge = x.where("_side = 0").withColumn("_r", F.row_number().over(Window.partitionBy(*g).orderBy(order_col)))
    edge = edge.withColumn(mark, F.col("_before") + F.col("_r") <= F.col("_k")).drop("_r")
    rest = x.where("_side <> 0").withColumn(mark, F.col("_side") < 0)
    return rest.unionByName(edge).drop("_b", "_edge", "_before", "_k", "_side")


def sample_fraction(df: DataFrame, group_cols: list[str], seed, keys: list[str],
                    fraction: float, rounding: str = "floor") -> DataFrame:
    """Exactly floor(f*n) (or ceil) rows per group without replacement.

    ``DataFrame.sampleBy`` is Bernoulli and cannot give exact counts.
    """
    rnd = F.floor if rounding == "floor" else F.ceil
    # n * f in decimal text avoids 0.1 * 30 = 3.0000000000000004 -> ceil 4.
    fr = F.lit(str(fraction)).cast("decimal(20,10)")
    x = with_order_key(df, seed, *group_cols, *keys)
    return first_k_per_group(x, group_cols, "_h", lambda n: rnd(n.cast("decimal(30,10)") * fr)).drop("_h")


def cap_per_group(df: DataFrame, group_cols: list[str], seed, keys: list[str], k: int) -> DataFrame:
    """At most k rows per group, drawn without replacement."""
    x = with_order_key(df, seed, *group_cols, *keys)
    return first_k_per_group(x, group_cols, "_h", k).drop("_h")


def train_test_split(df: DataFrame, group_col: str, seed, keys: list[str],
                     test_size: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Per group, ceil(test_size*n) rows to test, the rest to train."""
    x = df.withColumn("_h", hash_key(seed, group_col, *keys))
    marked = marked_first_k(x, [group_col], "_h",
                            lambda n: F.ceil(n.cast("decimal(30,10)") * F.lit(str(test_size)).cast("decimal(20,10)"))).drop("_h")
    return marked.where("NOT _in").drop("_in"), marked.where("_in").drop("_in")


def seeded_shuffle(df: DataFrame, seed, key: str, position: str | None = None) -> DataFrame:
    """Global seeded order (R5), for rows written in order; with ``position`` also each row's place, from 0.

    The order goes by the key's hash: places are offsets of hash ranges plus
    the place inside a range, so no task numbers all rows. Rows of equal keys
    follow their content.
    """
    x = df.withColumn("_h", hash_key(seed, key))
    if position is None:
        return x.orderBy("_h").drop("_h")
    x = x.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS)).withColumn("_h", F.struct("_h", F.to_json(F.struct(*df.columns))))
    return numbered(x, ["_b"], "_h", position).orderBy(position).drop("_b", "_h")


def numbered(df: DataFrame, buckets: list, order_col: str, out: str = "pos") -> DataFrame:
    """Number all rows from 0 by (``buckets``, ``order_col``) without one global window.

    ``buckets``: columns whose distinct values are few (a calendar, hash
    digits); their counts give each bucket its offset.
    """
    sizes = df.groupBy(*buckets).agg(F.count("*").alias("_c"))
    run = Window.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(run), F.lit(0))).drop("_c")
    place = Window.partitionBy(*buckets).orderBy(order_col)
    return (df.join(offsets, buckets).withColumn(out, (F.col("_o") + F.row_number().over(place) - 1).cast("long")).drop("_o"))


ROUNDS = 8                 # of the permutation; keys are 28 bits of a hash each
MODULUS = 2 ** 31 - 1      # of the round function; products stay below 2^62
MIN_SIDE, SIDES = 8, 15    # shortest side of a grid of positions; sides tried beyond the square root


def order_shape(n: Column) -> Column:
    """struct<a, b>: sides of the grid of entries for a population of n, a * b >= n and as close to n as a few sides allow.

    Entries whose position is n or more name nothing and are passed over (the
    order of the others is what walking on along the cycle would give), so
    ``k`` members need at most ``k + a * b - n`` entries.
    """
    side = F.greatest(F.lit(MIN_SIDE), F.ceil(F.sqrt(n))).cast("bigint")
    other = lambda a: F.greatest(F.lit(MIN_SIDE), F.ceil((n + a - 1 - F.pmod(n + a - 1, a)) / a)).cast("bigint")
    tried = F.transform(F.sequence(F.lit(0), F.least(F.lit(SIDES), F.floor((side - 1) / 2)).cast("int")), lambda i: F.struct(
        ((side + i) * other(side + i) - n).alias("spare"), (side + i).alias("a"), other(side + i).alias("b")))
    return F.array_min(tried)


def order_keys(seed, key: str) -> Column:
    """array<bigint>: the round keys of a key's own order; work them out once per key, before entries are listed."""
    words = [F.conv(F.substring(hash_key(f"{seed}|order{i}", key), 1 + 7 * k, 7), 16, 10).cast("bigint") for i in range(ROUNDS // 4) for k in range(4)]
    return F.array(*words)


def drawn_positions(df: DataFrame, j: str, keys: str, a: str, b: str, out: str = "pos") -> DataFrame:
    """Add ``out``: the position that entry ``j`` (0 .. a*b-1) of an order names; a keyed permutation of the grid a x b.

    A Feistel network over the two digits of an entry: each round adds a keyed
    cubic of one digit to the other, modulo that digit's side, so every round
    is one-to-one whatever the function. Rounds are projections of their own,
    which keeps the expression's size linear in the rounds, and the result
    passes a generator: a filter or join on it would otherwise be pushed
    below all rounds as one expression that has them many times over.
    """
    names = df.columns
    x = df.withColumns({"_u": F.floor(F.col(j) / F.col(b)).cast("bigint"), "_v": F.pmod(F.col(j), F.col(b))})
    sides = [F.col(a), F.col(b)]
    for i in range(ROUNDS):
        x = x.withColumn("_x", (F.col("_v") + F.get(F.col(keys), F.lit(i))) % MODULUS)
        mixed = F.col("_x") * F.col("_x") % MODULUS * F.col("_x") % MODULUS
        x = x.select(*names, F.col("_v").alias("_u"), ((F.col("_u") + mixed) % sides[i % 2]).alias("_v"))
    return x.select(*names, F.explode(F.array(F.col("_u") * F.col(b) + F.col("_v"))).alias(out))
