"""Mixing sources to target weights: a token budget handed down a domain-language-source tree.

All of it is DataFrame expressions. A node's budget goes to its children by
weight; a child that can't take its share (its texts times ``max_epochs`` are
fewer tokens) is filled up and what it lacks goes to its siblings by their
weights. Only what a whole subtree can't take reaches the ancestor's other
children, as a subtree's capacity is known before its parent deals. Shares are
whole tokens, rounded down; tokens times the sum of sibling weights must stay
below 2^63.

A leaf takes whole epochs of its texts as long as its budget lasts, and of the
next epoch the longest token-prefix: texts in the order of a hash of (seed,
epoch, doc_id), up to the last that still fits. The prefix is found without
sorting a leaf: sums per hash bucket find the bucket where the budget ends,
and only that bucket's rows (one of ``BUCKETS`` parts) are run through. A leaf
of any size thus costs one combined aggregate.

Children are settled in rounds of group sums, as many as siblings fill up one
after another; no group is collected or sorted.

Defined cases: a null text counts as empty (no tokens); a null language or
source is the name ''; rows of one doc_id share a place in the order and are
taken together, and so are rows without doc_id; a leaf without tokens is not
taken; an empty table gives an empty result; columns besides doc_id, text,
lang and source are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import materialize, pick

TOKEN = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3  # hex digits of the order's hash: 4096 buckets a leaf
TREE = (["domain"], ["domain", "language"], ["domain", "language", "source"])
MAX_ROUNDS = 1_000


@dataclass(frozen=True)
class Targets:
    """Weights of the tree. Domains claim sources by pattern, the first that fits; the last takes the rest."""

    domains: tuple[tuple[str, int, str], ...] = (("web", 5, "^src0$"), ("reference", 3, "^src[1-9]$"), ("other", 2, ""))
    languages: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 1})
    language_default: int = 1
    percent: int = 60       # budget, as a share of all tokens
    max_epochs: int = 4
    seed: int = 42


def _domain(t: Targets, source: Column) -> tuple[Column, Column]:
    name, weight = F.lit(None), F.lit(None)
    for n, w, pattern in reversed(t.domains):
        fits = source.rlike(pattern) if pattern else F.lit(True)
        name, weight = F.when(fits, n).otherwise(name), F.when(fits, w).otherwise(weight)
    return name, weight.cast("bigint")


def _language_weight(t: Targets, language: Column) -> Column:
    w = F.lit(t.language_default)
    for name, value in t.languages.items():
        w = F.when(language == name, value).otherwise(w)
    return w.cast("bigint")


def _leaf_columns(t: Targets, lang: Column, source: Column) -> list[Column]:
    source = F.coalesce(source.cast("string"), F.lit(""))
    return [_domain(t, source)[0].alias("domain"), F.coalesce(lang.cast("string"), F.lit("")).alias("language"), source.alias("source")]


def _order_key(t: Targets, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(t.seed)), epoch.cast("string"), doc_id.cast("string")))


def fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (``parent`` columns, ``weight``, ``capacity``, ``budget`` of the parent) with ``share``."""
    rest = [c for c in children.columns if c not in parent]
    now = children.withColumn("full", F.lit(False))
    for _ in range(MAX_ROUNDS):
        totals = now.groupBy(*parent).agg(
            F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).alias("used"),
            F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).alias("open_weight"))
        joined = now.join(totals, parent)
        left = F.col("budget") - F.col("used")
        now = materialize(joined.withColumn(
            "fills", ~F.col("full") & (F.col("capacity") * F.col("open_weight") <= left * F.col("weight"))), "children")
        if now.where("fills").isEmpty():
            share = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("((budget - used) * weight) div open_weight"))
            return now.select(*parent, *rest, share.alias("share"))
        now = now.select(*parent, *rest, (F.col("full") | F.col("fills")).alias("full"))
    raise RuntimeError(f"shares not settled after {MAX_ROUNDS} rounds")


def leaves(rows: DataFrame, t: Targets) -> DataFrame:
    """Per leaf of ``rows`` (leaf columns, ``n_tokens``): ``tokens``, ``share``, whole ``epochs`` and the ``rest`` in tokens."""
    leaf = materialize(rows.groupBy(*TREE[2]).agg(F.sum("n_tokens").alias("tokens")).withColumn("root", F.lit(0)), "leaves")
    nodes = leaf.withColumn("capacity", F.col("tokens") * t.max_epochs)
    above = leaf.groupBy("root").agg(F.sum("tokens").alias("tokens")).select(
        "root", F.expr(f"tokens * {t.percent} div 100").alias("budget"))
    weights = {"domain": _domain(t, F.col("source"))[1], "language": _language_weight(t, F.col("language")),
               "source": F.lit(1).cast("bigint")}
    parent = ["root"]
    for path in TREE:
        sums = nodes.groupBy(*parent, path[-1]).agg(F.sum("capacity").alias("capacity"), F.max(weights[path[-1]]).alias("weight"))
        above = fill(sums.join(above, parent), parent).select(*parent, path[-1], F.col("share").alias("budget")).drop("root")
        parent = path
    shares = above.join(leaf.drop("root"), TREE[2])
    return materialize(shares.select(
        *TREE[2], "tokens", F.col("budget").alias("share"),
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("epochs"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest")), "leaves")


def cutoffs(rows: DataFrame, leaf: DataFrame, t: Targets) -> DataFrame:
    """``leaf`` with ``cutoff``: the last order key that the epoch begun still takes (null: none)."""
    key = TREE[2]
    keyed = rows.join(leaf.where("rest > 0").select(*key, "epochs", "rest"), key).select(
        *key, "rest", "n_tokens", _order_key(t, F.col("epochs"), F.col("doc_id")).alias("order_key"))
    keyed = keyed.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*key, "rest", "bucket").agg(F.sum("n_tokens").alias("n_tokens"), F.max("order_key").alias("last_key"))
    # at most 4096 rows a leaf from here on
    spans = materialize(sums.withColumn("upto", F.expr(
        f"sum(n_tokens) OVER (PARTITION BY {', '.join(key)} ORDER BY bucket)")), "spans")
    whole = spans.where("upto <= rest").groupBy(*key).agg(F.max("last_key").alias("cutoff"))
    ends = spans.where("upto > rest AND upto - n_tokens <= rest").select(*key, "bucket", (F.col("upto") - F.col("n_tokens")).alias("before"))
    within = (keyed.join(ends, [*key, "bucket"])
              .withColumn("upto", F.col("before") + F.expr(f"sum(n_tokens) OVER (PARTITION BY {', '.join(key)}, bucket ORDER BY order_key)"))
              .where("upto <= rest").groupBy(*key).agg(F.max("order_key").alias("cutoff")))
    last = whole.unionByName(within).groupBy(*key).agg(F.max("cutoff").alias("cutoff"))
    return materialize(leaf.join(last, key, "left"), "cutoffs")


def _copies(t: Targets, doc_id: Column) -> Column:
    begun = F.coalesce(_order_key(t, F.col("epochs"), doc_id) <= F.col("cutoff"), F.lit(False))
    return F.col("epochs") + begun.cast("bigint")


def _narrow(docs: DataFrame, t: Targets) -> DataFrame:
    d = pick(docs, "doc_id", "text", "lang", "source")
    return materialize(d.select("doc_id", *_leaf_columns(t, F.col("lang"), F.col("source")),
                                F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("bigint").alias("n_tokens")), "tokens")


def plan(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """``doc_id``, leaf columns, ``n_tokens`` and ``copies`` (0: not taken) of every row."""
    t = targets or Targets()
    rows = _narrow(docs, t)
    leaf = cutoffs(rows, leaves(rows, t), t)
    return rows.join(leaf.select(*TREE[2], "epochs", "cutoff"), TREE[2]).select(
        "doc_id", *TREE[2], "n_tokens", _copies(t, F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken; columns as they are."""
    t = targets or Targets()
    rows = _narrow(docs, t)
    leaf = cutoffs(rows, leaves(rows, t), t).where("epochs > 0 OR cutoff IS NOT NULL").select(*TREE[2], "epochs", "cutoff")
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {n: F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "lang", "source")}
    keyed = flat.select("*", *_leaf_columns(t, at["lang"], at["source"]))
    taken = keyed.join(leaf, TREE[2]).withColumn("copies", _copies(t, at["doc_id"])).where("copies > 0")
    return taken.select(*flat.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy").toDF(*docs.columns)
