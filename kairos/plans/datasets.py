"""Example datasets (E2-E5): keys and label lists first, text later.

Shuffle boundaries: cohorts by customer, prices by (ISIN, cutoff), labels by
(cutoff, customer). Lists are assembled per example only at the end; the
profitable set is kept per cutoff (one row per (cutoff, ISIN)) instead of
being copied into every example.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairos.functions.dates import HORIZON_DAYS, TEST_GRID, TRAIN_GRID, CutoffGrid, date_text
from kairos.functions.hashing import hash_key
from kairos.operators import sampling, temporal
from kairos.session import build_once, cut_lineage

SEED = 2025
MAX_RECOMMENDATIONS = 20


def example_id(customer="customerID", cutoff="cutoff"):
    return F.concat_ws("@", F.col(customer), date_text(F.col(cutoff)))


@dataclass
class Labels:
    examples: DataFrame      # (example_id, k, cutoff, customerID[, client_id])
    purchases: DataFrame     # (example_id, ISIN) future purchases of each example
    good: DataFrame          # (example_id, ISIN) purchases that were profitable
    profitable: DataFrame    # (k, cutoff, ISIN) per cutoff, shared by its examples


def _labels(transactions, prices, grid: CutoffGrid, keep: DataFrame | None,
            horizon_days: int) -> Labels:
    """Each part is written once, and found again by later queries on the same inputs; whatever is built on labels starts from those tables."""
    pur = temporal.horizon_purchases(transactions, grid, horizon_days)
    if keep is not None:
        # sorted files of ids are small for what they hold: without the hint Spark would broadcast all samples
        keep = build_once(keep, "sampled").hint("merge")
        pur = pur.join(keep.select("k", "customerID"), ["k", "customerID"], "left_semi")
    pur = build_once(pur.withColumn("example_id", example_id()), "purchases")
    prof = build_once(temporal.profitable_assets(prices, grid, horizon_days).select("k", "cutoff", "ISIN"), "profitable")
    # nor the profitable assets, whose names and cutoffs are a few MB as files and hundreds in a broadcast
    good = build_once(temporal.good_assets(pur, prof.hint("merge")), "good")
    ex = good.select("k", "cutoff", "customerID", "example_id").distinct()
    if keep is not None and "client_id" in keep.columns:
        ex = ex.join(keep.select("k", "customerID", "client_id"), ["k", "customerID"])
    ex = build_once(ex, "examples")
    pur = pur.join(ex.select("example_id"), "example_id", "left_semi")
    return Labels(ex, pur.select("example_id", "ISIN"), good.select("example_id", "ISIN"), prof)


def sampled_customers(assigned: DataFrame, grid: CutoffGrid, fraction: float = 0.2,
                      seed=SEED) -> DataFrame:
    """(client_id, k, customerID): floor(n/5) customers of each client per cutoff."""
    cand = assigned.select("client_id", "customerID").withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(grid.count - 1))))
    return sampling.sample_fraction(cand, ["client_id", "k"], seed, ["customerID"], fraction, "floor")


def test_labels(transactions, prices, grid: CutoffGrid = TEST_GRID,
                horizon_days: int = HORIZON_DAYS) -> Labels:
    """Test examples (E4): every customer, every cutoff, profitability over all assets."""
    return _labels(transactions, prices, grid, None, horizon_days)


def train_labels(transactions, prices, assigned, grid: CutoffGrid = TRAIN_GRID,
                 horizon_days: int = HORIZON_DAYS, seed=SEED) -> Labels:
    """Train examples (E2): a fifth of each client's customers per cutoff."""
    keep = sampled_customers(assigned, grid, 0.2, seed)
    return _labels(transactions, prices, grid, keep, horizon_days)


def capped_good(labels: Labels, k: int = MAX_RECOMMENDATIONS, seed=SEED) -> DataFrame:
    """(example_id, ISIN): at most k good assets per example, without replacement."""
    return sampling.cap_per_group(labels.good, ["example_id"], f"{seed}|good", ["ISIN"], k)


def numbered_assets(assets: DataFrame, seed=SEED) -> tuple[DataFrame, int]:
    """(ISIN, pos) with positions in a seeded order, and their number."""
    x = assets.select("ISIN").distinct().withColumn("_h", hash_key(f"{seed}|asset", "ISIN"))
    x = x.withColumn("_b", F.substring("_h", 1, 3))
    out = build_once(sampling.numbered(x, ["_b"], "_h").select("ISIN", "pos"), "assets")
    return out, out.count()


def draw_assets(wanted: DataFrame, assets: DataFrame, key: str, seed) -> DataFrame:
    """(``key``, j, ISIN): the first ``need`` assets, and a few more, of each key's own order of all assets. ``wanted``: (key, need).

    Every key has its own permutation; the cost is the entries drawn, never
    keys x assets. Every position below the number of assets has its asset,
    so the outer join finds all; of the two sides only the assets can then be
    broadcast, never the entries, which Spark takes for as few as the keys.
    """
    pool, m = numbered_assets(assets, seed)
    x = wanted.withColumns({"_n": F.lit(m).cast("bigint"), "_keys": sampling.order_keys(seed, key)}).withColumn("_s", sampling.order_shape(F.col("_n")))
    x = x.select(key, "need", "_n", "_keys", "_s.*").where("_n > 0")
    last = F.least(F.col("need") + F.col("spare"), F.col("a") * F.col("b"))
    entries = sampling.drawn_positions(x.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), last - 1))), "j", "_keys", "a", "b")
    return entries.where(F.col("pos") < F.col("_n")).select(key, "j", "pos").join(pool, "pos", "left").select(key, "j", "ISIN")


def bad_assets(labels: Labels, assets: DataFrame, k: int = MAX_RECOMMENDATIONS, seed=SEED) -> DataFrame:
    """(example_id, ISIN): k assets outside the example's good set, drawn for each example on its own.

    An example's good assets meet its draws as one list, in the shuffle that
    also ranks them; the result lies by example.
    """
    own = labels.good.groupBy("example_id").agg((F.count("*") + F.lit(k)).alias("need"), F.collect_set("ISIN").alias("_good"))
    drawn = draw_assets(own.select("example_id", "need"), assets, "example_id", f"{seed}|bad")
    cand = drawn.join(own.select("example_id", "_good"), "example_id")
    cand = cand.where(~F.coalesce(F.array_contains("_good", F.col("ISIN")), F.lit(False))).drop("_good")
    w = Window.partitionBy("example_id").orderBy("j")
    return cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("example_id", "ISIN")


def list_of(pairs: DataFrame, name: str) -> DataFrame:
    """(example_id, name array<string>) sorted; size bounded by the example's own rows."""
    return pairs.groupBy("example_id").agg(F.array_sort(F.collect_set("ISIN")).alias(name))


def small_sample(examples: DataFrame, fraction: float = 0.01, seed=SEED, rounding="floor") -> DataFrame:
    """floor(f * n) examples per cutoff (E5), or ceil for the 'smaller' evaluation run."""
    return sampling.sample_fraction(examples, ["k"], f"{seed}|small", ["example_id"], fraction, rounding)
