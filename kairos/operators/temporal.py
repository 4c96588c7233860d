"""Point-in-time operators: horizon join, as-of prices, profitability, ten-week bins.

Cutoffs form a regular grid (``kairos.functions.dates.CutoffGrid``); every
fact finds its cutoffs by arithmetic, so none of these joins is a range join:
the only shuffles are the aggregations on their natural keys. For arbitrary
cutoffs and keys there are ``interval_join`` and ``asof_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.functions.dates import (DAY_MICROS, HORIZON_DAYS, CutoffGrid, asof_bucket, cutoff_of,
                                    horizon_indexes, in_horizons, micros, up_to_newest)
from kairos.session import cut_lineage


def horizon_purchases(transactions: DataFrame, grid: CutoffGrid,
                      horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """(k, cutoff, customerID, ISIN): distinct buys with cutoff < ts <= cutoff + horizon.

    Each buy fans out to at most ceil(horizon/step)+1 cutoffs; the distinct is
    combined map-side before the shuffle on its keys.
    """
    buys = transactions.where((F.col("transactionType") == "Buy") & in_horizons(grid, F.col("timestamp"), horizon_days)).select(
        "customerID", "ISIN", F.explode(horizon_indexes(grid, F.col("timestamp"), horizon_days)).alias("k"))
    return (buys.distinct()
            .withColumn("cutoff", cutoff_of(grid, F.col("k")))
            .select("k", "cutoff", "customerID", "ISIN"))


def _last(price="closePrice", ts="timestamp"):
    # Deterministic on ties: the larger price wins between equal timestamps.
    return F.max_by(F.col(price), F.struct(F.col(ts), F.col(price)))


def start_prices(prices: DataFrame, grid: CutoffGrid) -> DataFrame:
    """(k, cutoff, ISIN, start_price): last non-null price at or before each cutoff.

    Each price goes to exactly one bucket (the nearest cutoff at or after it),
    buckets are reduced map-side, and per ISIN at most ``grid.count`` bucket
    values are carried forward to every later cutoff.
    """
    p = prices.where(F.col("closePrice").isNotNull() & up_to_newest(grid, F.col("timestamp")))
    buckets = (p.withColumn("b", asof_bucket(grid, F.col("timestamp"))).where(F.col("b").isNotNull())
               .groupBy("ISIN", "b")
               .agg(F.max_by(F.struct("timestamp", "closePrice"),
                             F.struct("timestamp", "closePrice")).alias("last")))
    per_isin = buckets.groupBy("ISIN").agg(
        F.collect_list(F.struct("b", "last")).alias("bs"), F.max("b").alias("maxb"))
    ks = per_isin.select("ISIN", "bs", F.explode(F.sequence(F.lit(0), F.col("maxb"))).alias("k"))
    picked = F.array_max(F.transform(F.filter("bs", lambda x: x["b"] >= F.col("k")), lambda x: x["last"]))
    return ks.select("k", cutoff_of(grid, F.col("k")).alias("cutoff"), "ISIN",
                     picked["closePrice"].alias("start_price"))


def end_prices(prices: DataFrame, grid: CutoffGrid, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """(k, cutoff, ISIN, end_price): last non-null price in (cutoff, cutoff + horizon]."""
    p = prices.where(F.col("closePrice").isNotNull() & in_horizons(grid, F.col("timestamp"), horizon_days)).select(
        "ISIN", "timestamp", "closePrice",
        F.explode(horizon_indexes(grid, F.col("timestamp"), horizon_days)).alias("k"))
    return (p.groupBy("k", "ISIN").agg(_last().alias("end_price"))
            .select("k", cutoff_of(grid, F.col("k")).alias("cutoff"), "ISIN", "end_price"))


def price_moves(prices: DataFrame, grid: CutoffGrid, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """(k, cutoff, ISIN, start_price, end_price) where both exist."""
    s = start_prices(prices, grid)
    e = end_prices(prices, grid, horizon_days).drop("cutoff")
    return s.join(e, ["k", "ISIN"], "inner").select("k", "cutoff", "ISIN", "start_price", "end_price")


def profitable_assets(prices: DataFrame, grid: CutoffGrid, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """(k, cutoff, ISIN, start_price, end_price) with end_price > start_price."""
    return price_moves(prices, grid, horizon_days).where(F.col("end_price") > F.col("start_price"))


def good_assets(purchases: DataFrame, profitable: DataFrame) -> DataFrame:
    """Purchases that were profitable (J8, U4): semi join on (k, ISIN)."""
    return purchases.join(profitable.select("k", "ISIN"), ["k", "ISIN"], "left_semi")


def ten_week_summary(prices: DataFrame, weeks: int = 10) -> DataFrame:
    """(ISIN, period_end, end_price, avg_price, high_price, low_price) per ten-week bin.

    Bins are Sunday-anchored per ISIN, closed and labelled on the right: the
    anchor is the first Sunday on or after the ISIN's first date (a null price
    still anchors), and bin ``i`` ends ``anchor + 7*weeks*i`` days. Bins
    without a price are dropped. The first date is a combined minimum, so no
    task holds all rows of an ISIN.
    """
    span = 7 * weeks
    d = F.to_date("timestamp")
    first = prices.groupBy("ISIN").agg(F.min(d).alias("_d0"))
    anchor = F.date_add(F.col("_d0"), (F.lit(6) - F.weekday(F.col("_d0"))).cast("int"))
    idx = F.greatest(F.lit(0), F.ceil(F.datediff(d, anchor) / F.lit(span))).cast("int")
    binned = (prices.join(first, "ISIN")
              .withColumn("period_end", F.date_add(anchor, idx * F.lit(span)))
              .where(F.col("closePrice").isNotNull()))
    # The mean sums the bin's prices in ascending order (a bin holds at most
    # 7*weeks rows), so it is bit-identical for any partitioning.
    return binned.groupBy("ISIN", "period_end").agg(
        _last().alias("end_price"),
        (F.aggregate(F.array_sort(F.collect_list("closePrice")), F.lit(0.0), lambda a, x: a + x)
         / F.count("closePrice")).alias("avg_price"),
        F.max("closePrice").alias("high_price"),
        F.min("closePrice").alias("low_price"))


def all_assets(prices: DataFrame) -> DataFrame:
    """Distinct ISINs with any price row (A3)."""
    return prices.select("ISIN").distinct()


# ------------------------------------------------------------- arbitrary cutoffs and keys

def interval_join(facts: DataFrame, intervals: DataFrame, keys: list[str], ts: str, low: str, high: str) -> DataFrame:
    """Every fact with every interval of its keys that holds it, low < ts <= high (J4 for any cutoffs and horizons).

    An interval belongs to the tier whose bucket width is the smallest power
    of two of days that covers its length, so it meets at most two or three
    buckets of that width; a fact has one bucket in each tier that occurs (64
    at most, read on the driver). The join is an equi-join on keys, tier and
    bucket, which also cuts a hot key by time, and each pair meets once.
    """
    span = F.greatest(F.lit(1), micros(F.col(high)) - micros(F.col(low))) / DAY_MICROS
    tier = F.greatest(F.lit(0), F.ceil(F.log2(span))).cast("int")
    cut = intervals.where(F.col(low) < F.col(high)).withColumn("_tier", tier)
    tiers = sorted(r["_tier"] for r in cut.select("_tier").distinct().collect())

    def bucket(t: Column, width_tier: Column) -> Column:
        width = F.lit(DAY_MICROS) * F.expr("shiftleft(CAST(1 AS BIGINT), _tier)") if width_tier is None else F.lit(DAY_MICROS) * width_tier
        return ((t - F.pmod(t, width)) / width).cast("bigint")
    cut = cut.withColumn("_bucket", F.explode(F.sequence(bucket(micros(F.col(low)), None), bucket(micros(F.col(high)), None))))
    held = facts.withColumn("_at", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tier"), bucket(micros(F.col(ts)), F.lit(1 << t)).alias("bucket")) for t in tiers]) if tiers else
        F.array().cast("array<struct<tier:int,bucket:bigint>>")))
    held = held.withColumns({"_tier": F.col("_at.tier"), "_bucket": F.col("_at.bucket")}).drop("_at")
    both = held.join(cut, [*keys, "_tier", "_bucket"])
    return both.where((F.col(low) < F.col(ts)) & (F.col(ts) <= F.col(high))).drop("_tier", "_bucket")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], tie: str | None = None,
              tolerance_days: int | None = None, strict: bool = False, parts: int | None = None) -> DataFrame:
    """Each row of ``left`` with ``values`` and ``right_ts`` of the last row of ``right`` with its keys at or before its time.

    ``strict``: before its time. Of right rows at the same time the one with
    the largest ``tie`` counts (then the largest values). Older rows than
    ``tolerance_days`` don't count. Rows without a match, or with null keys or
    times, get nulls.

    Both sides lie in ranges of (keys, time), so a hot key is spread over many
    tasks; inside a range the last right row is carried forward, and each
    range hands one row per key on to the next ones. No window holds a key's
    whole history but that of the one row per range.
    """
    spark = left.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.struct(F.col(right_ts).alias("ts"), (F.col(tie) if tie else F.lit(0)).alias("tie"), *values)
    known = F.col(right_ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    r = right.where(known).select(*keys, F.col(right_ts).alias("_t"), F.lit(1 if strict else 0).alias("_side"), order.alias("_right"))
    names = left.columns
    rows = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*names).alias("_left"))
    both = r.unionByName(rows, allowMissingColumns=True).repartitionByRange(parts, *keys, "_t").withColumn("_range", F.spark_partition_id())
    both = cut_lineage(both, "ranges")
    inside = Window.partitionBy("_range", *keys).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_own", F.last("_right", ignorenulls=True).over(inside)).where(F.col("_left").isNotNull())
    edges = both.groupBy("_range", *keys).agg(F.max("_right").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).where(F.col("_carried").isNotNull()).drop("_last")
    found = filled.join(edges, ["_range", *keys], "left").withColumn("_m", F.coalesce("_own", "_carried"))
    good = F.col("_t").isNotNull()
    if tolerance_days is not None:
        good = good & (micros(F.col("_m.ts")) >= micros(F.col("_t")) - tolerance_days * DAY_MICROS)
    return found.select(*[F.col("_left")[n].alias(n) for n in names], F.when(good, F.col("_m.ts")).alias(f"matched_{right_ts}"),
                        *[F.when(good, F.col("_m")[v]).alias(v) for v in values])
