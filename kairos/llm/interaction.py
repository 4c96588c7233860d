"""Filter interaction audit: what each filter removes in every order, by a recursive CTE over filter prefixes.

1. Every document gets a bit mask of the filters it fails. Per part (language)
   the documents are counted by mask: a cell. There are at most 2^k cells a
   part, however many documents there are.
2. A recursive CTE starts with the empty prefix and the masks that occur and
   extends every prefix by each letter it lacks, carrying the bits applied so
   far. Its rows depend on the number of filters alone. A level joins the
   cells on the mask and sums up that step's metrics per part and prefix.
3. A full order reads the metrics of its own prefixes, so each prefix is
   worked out once, not once per order. A filter's Shapley sum weighs each
   prefix by the orders that go on from it.

The copy filter needs the smallest id of each text: ids are reduced to it per
text (combined before the shuffle), and joined back on text and id together,
so copies of one text, a third of all rows maybe, lie on as many keys as they
have ids.

Defined cases: a null text counts as empty, a null language as ''. A document
without id is no copy of any and makes none; repeated rows count each, and
rows of one id are no copies of each other; a labels row counts if it says 1,
and several of one id as any of them; ids without labels are neither good nor
toxic. Columns besides doc_id, text, lang (quality, toxic) are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import WORD_GAP, materialize, pick

SALTS = 4096  # rows without id meet no label; so many keys share them


@dataclass(frozen=True)
class Filter:
    """A letter and when a document fails; ``test`` gets the text, its words and the number of different words."""

    letter: str
    test: object  # callable of three columns, or None: a copy of a smaller id's text


def _capitals(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))


FILTERS = (
    Filter("A", lambda text, words, kinds: words < 200),
    Filter("B", lambda text, words, kinds: 100 * kinds < 50 * words),
    Filter("C", lambda text, words, kinds: 100 * _capitals(text) > 3 * F.length(text)),
    Filter("D", lambda text, words, kinds: text.rlike("[#$%&*|]")),
    Filter("E", None),
)


def failures(docs: DataFrame, filters=FILTERS) -> DataFrame:
    """``digest`` (of the text), ``doc_id``, ``part``, ``mask``, ``n``: the filters (bit i: the i-th) that the n equal rows of an id fail."""
    d = pick(docs, "doc_id", "text", "lang").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", f"[{WORD_GAP}]+"), "")
    d = d.withColumn("found", words).withColumns({"words": F.size("found"), "kinds": F.size(F.array_distinct("found"))})
    own = F.lit(0)
    for i, f in enumerate(filters):
        if f.test is not None:
            own = own + F.when(f.test(F.col("text"), F.col("words"), F.col("kinds")), 1 << i).otherwise(0)
    each = d.select("doc_id", "part", F.sha2("text", 256).alias("digest"), own.cast("int").alias("mask"))
    each = materialize(each.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    copy_bits = sum(1 << i for i, f in enumerate(filters) if f.test is None)
    if not copy_bits:
        return each
    least = each.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_least", F.lit(True))
    first = each.join(least, ["digest", "doc_id"], "left")
    is_copy = F.col("is_least").isNull() & F.col("doc_id").isNotNull()
    return first.select("digest", "doc_id", "part", (F.col("mask") + F.when(is_copy, copy_bits).otherwise(0)).cast("int").alias("mask"), "n")


def cells(docs: DataFrame, labels: DataFrame, filters=FILTERS) -> DataFrame:
    """``part``, ``mask`` and the documents in it: ``n``, ``good`` (quality 1) and ``toxic`` (toxic 1)."""
    marks = pick(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = failures(docs, filters).withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"))


# walk: one row per prefix and mask; applied holds the prefix's bits, bit its last letter's
WALK = """
WITH RECURSIVE walk(prefix, step, applied, bit, mask) AS (
  SELECT CAST('' AS STRING), 0, 0, 0, mask FROM (SELECT DISTINCT mask FROM {cells})
  UNION ALL
  SELECT concat(prefix, f.letter), step + 1, applied | f.bit, f.bit, mask
  FROM walk LATERAL VIEW explode(filter(array(LETTERS), x -> (applied & x.bit) = 0)) e AS f)
SELECT * FROM walk WHERE step > 0"""


def audit(docs: DataFrame, labels: DataFrame, filters=FILTERS) -> DataFrame:
    """Per ``part``, ``filter_order`` and ``step``: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``."""
    spark = docs.sparkSession
    k = len(filters)
    cell = materialize(cells(docs, labels, filters), "cells")  # 2^k rows a part at most
    letters = ", ".join(f"named_struct('letter', '{f.letter}', 'bit', {1 << i})" for i, f in enumerate(filters))
    walk = materialize(spark.sql(WALK.replace("LETTERS", letters), cells=cell), "walk")  # of a size set by the number of filters
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("applied") - F.col("bit"))
    goes = fails & (before == 0)

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))
    metrics = cell.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "step", "bit").agg(
        total(F.col("mask").bitwiseAND(F.col("applied")) == 0).alias("kept"), total(goes).alias("removed"),
        total(fails & (before != 0)).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(goes, "good").alias("good_lost"), total(goes, "toxic").alias("toxic_lost"))
    metrics = materialize(metrics, "metrics")
    # orders that go on from a prefix
    ways = F.element_at(F.array(*[F.lit(factorial(k - s)) for s in range(1, k + 1)]), F.col("step"))
    shapley = metrics.groupBy("part", "bit").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    orders = walk.where(F.col("step") == k).select(F.col("prefix").alias("filter_order")).distinct().select(
        "filter_order", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    orders = orders.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    return metrics.join(F.broadcast(orders), ["prefix", "step"]).join(shapley, ["part", "bit"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley")
