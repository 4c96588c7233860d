"""Source divergence audit: how far the sources of a language differ in their terms, by count-level bitmaps.

A language keeps the terms of at least ``MIN_DOCS`` of its documents. Every
(language, source) group gives a kept term with count c the share p(c), which
depends on c and on the group's totals alone. So a group is told by one bitmap
of term ids per count it has: two groups differ in a term by |p(c) - p(c')|,
and the AND of two bitmaps with a popcount says for how many terms. The terms
a group lacks are the complement of its bitmaps.

* Counting: each task counts terms per group, sums are combined by Spark.
* Term ids: terms of a language with totals of the same power of two are dealt
  into chunks of about ``CHUNK`` by hash and numbered inside a chunk. Counts
  of such terms are alike, so a chunk has few levels per group.
* Bitmaps: words of 64 bits per (group, chunk, count), OR-ed by Spark. The
  bitmaps of a chunk for a block of ``SOURCES`` groups are one row.
* Pairs: a chunk's rows of two blocks meet, which bounds a task's rows by
  SOURCES, CHUNK and nothing else; sums over chunks give a pair's divergence.
  The result holds every pair of a language's sources, as the audit asks.

All numbers are whole and exact: shares are worked out in decimals, divergences
as longs.

Defined cases: null text, lang and source count as ''; every row is a
document, repeated ones too; a group without kept terms has count 0 for each;
a language without kept terms has divergence 0 throughout; columns besides
text, lang and source are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.llm.common import materialize, pick

MIN_DOCS = 30
TOP_TERMS = 50
ADDED = 5                # to every count
SCALE = 1_000_000_000    # of shares
CHUNK, SOURCES, SALTS = 512, 64, 64
HELD = 300_000           # counts a task holds before it puts them out

#: Letters to lower case, everything else below 128 to blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (places) and ``docs`` (documents); each group also has a row without a term."""
    d = pick(docs, "text", "lang", "source").select(
        F.coalesce("text", F.lit("")).cast("binary").alias("text"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])

    def work(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def put_out():
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                yield pd.DataFrame({"lang": lang, "source": source, "term": [None, *terms], "n": [0, *n.values()],
                                    "docs": [0, *[docs[t] for t in terms]]})
        for b in batches:
            for text, lang, source in zip(b["text"], b["lang"], b["source"]):
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                n, docs = held[lang, source]
                words = text.translate(LETTERS).split()
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) >= HELD:
                yield from put_out()
                held = {}
        yield from put_out()
    counted = d.mapInPandas(work, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """p = 1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), whole and exact."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {ADDED} AS DECIMAL(20,0)) "
                  f"div CAST(greatest({total} + {ADDED} * {terms}, 1) AS DECIMAL(20,0))")


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """``lang``, ``term``, ``total`` and its place: ``power``, ``chunk`` and ``place`` in the chunk, from 0."""
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    terms = terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("power"))
    sizes = terms.groupBy("lang", "power").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    # most terms of a language are of a few powers: each power meets its size under many salts
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = terms.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "power", "salt"]).withColumn(
        "chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).drop("chunks", "salt")
    place = Window.partitionBy("lang", "power", "chunk").orderBy("term")
    return dealt.withColumn("place", F.row_number().over(place) - 1)


class Bitmaps:
    """The levels of a block's groups in one chunk: shares, bits, and where each group's levels start."""

    def __init__(self, slots, zero, slot, p, word, bits, n_terms: int):
        width = -(-n_terms // 64)
        every = np.full(width, ~np.uint64(0))
        if n_terms % 64:
            every[-1] = (np.uint64(1) << np.uint64(n_terms % 64)) - np.uint64(1)
        slot, p, word = (np.asarray(x, np.int64) for x in (slot, p, word))
        bits = np.asarray(bits, np.int64).view(np.uint64)
        self.slots, shares, rows, self.starts = np.asarray(slots, np.int64), [], [], []
        at = 0
        for s, p0 in zip(self.slots, zero):
            own = np.flatnonzero(slot == s)
            levels, back = np.unique(p[own], return_inverse=True)
            level_bits = np.zeros((len(levels) + 1, width), np.uint64)
            level_bits[back, word[own]] = bits[own]
            level_bits[-1] = every & ~np.bitwise_or.reduce(level_bits[:-1], axis=0, initial=np.uint64(0))  # terms it lacks
            shares.append(np.append(levels, p0))
            rows.append(level_bits)
            self.starts.append(at)
            at += len(level_bits)
        self.shares, self.bits, self.ends = np.concatenate(shares), np.concatenate(rows), [*self.starts[1:], at]

    def divergences(self, other: "Bitmaps") -> np.ndarray:
        """Groups of this block by groups of the other: sum over the chunk's terms of the difference of shares."""
        out = np.zeros((len(self.slots), len(other.slots)), np.int64)
        for g, (lo, hi) in enumerate(zip(self.starts, self.ends)):
            for k in range(lo, hi):
                joint = np.bitwise_count(other.bits & self.bits[k]).sum(axis=1, dtype=np.int64)
                out[g] += np.add.reduceat(joint * np.abs(other.shares - self.shares[k]), other.starts)
        return out


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value``, ``rank``."""
    counts = materialize(term_counts(docs), "counts")
    kept = materialize(kept_terms(counts, min_docs), "terms")
    cells = materialize(counts.where("n > 0").drop("docs").join(kept, ["lang", "term"]), "cells")
    # one row per language, then one per group
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_sum"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_sum"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(
        0, ["own_sum", "terms", "lang_sum"]).withColumn("number", number)
    groups = materialize(groups.select("*", F.floor(F.col("number") / SOURCES).cast("int").alias("block"),
                                       share("0", "own_sum", "terms").alias("p0")), "groups")
    told = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "own_sum", "terms"))
    found = pair_values(told, kept, groups).unionByName(term_values(told, top))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(place)).select("lang", "source", "part", "item", "value", "rank")


def term_values(told: DataFrame, top: int) -> DataFrame:
    """Each group's terms of the largest shares above the language's."""
    over = told.withColumn("value", F.col("p") - share("total", "lang_sum", "terms")).where("value > 0")
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return over.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")


def pair_values(told: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """The divergence of every two groups of a language, both ways."""
    chunk = ["lang", "power", "chunk"]
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(place % 64 AS INT))")
    levels = told.groupBy(*chunk, "block", "number", "n", "p", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits"))
    maps = levels.groupBy(*chunk, "block").agg(F.collect_list(F.struct("number", "p", "word", "bits")).alias("levels"))
    # every chunk meets every block of its language; a language without terms has one empty chunk
    chunks = kept.groupBy(*chunk).agg(F.count(F.lit(1)).alias("n_terms")).unionByName(groups.where("terms = 0").select(
        "lang", F.lit(-1).alias("power"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("n_terms")).distinct())
    blocks = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("number", "p0"))).alias("own"))
    rows = chunks.join(blocks, "lang").join(maps, [*chunk, "block"], "left").select(
        *chunk, "n_terms", "block", F.struct(F.col("own.number").alias("slots"), F.col("own.p0").alias("zero"), *[
            F.coalesce(F.col(f"levels.{c}"), F.array().cast(f"array<{t}>")).alias(c)
            for c, t in (("number", "int"), ("p", "bigint"), ("word", "int"), ("bits", "bigint"))]).alias("map"))
    rows = materialize(rows, "bitmaps")
    two = rows.join(rows.select(*chunk, F.col("block").alias("other_block"), F.col("map").alias("other")), chunk).where("block <= other_block")
    flat = two.select("lang", "n_terms", "block", "other_block", "map.*", *[
        F.col(f"other.{c}").alias(f"other_{c}") for c in ("slots", "zero", "number", "p", "word", "bits")])
    names = ("slots", "zero", "number", "p", "word", "bits")

    def meet(batches):
        for b in batches:
            for r in b.to_dict("records"):
                one = Bitmaps(*[r[c] for c in names], r["n_terms"])
                two = one if r["block"] == r["other_block"] else Bitmaps(*[r[f"other_{c}"] for c in names], r["n_terms"])
                value = one.divergences(two)
                i, j = np.nonzero(one.slots[:, None] < two.slots[None, :])
                yield pd.DataFrame({"lang": r["lang"], "a": one.slots[i], "b": two.slots[j], "value": value[i, j]})
    sums = flat.mapInPandas(meet, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    name = groups.select("lang", "source", F.col("number").cast("long").alias("number"))
    return (both.select("lang", F.col("x.a").alias("number"), F.col("x.b").alias("with"), "value").join(name, ["lang", "number"])
            .join(name.select("lang", F.col("source").alias("item"), F.col("number").alias("with")), ["lang", "with"])
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
