"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees.

A fingerprint bit is 1 if it is set in over half of the XXH64 values of a
text's shingles. Fingerprints at most ``bits`` apart are linked; a group is
what links reach.

Finding links. Equal fingerprints are one node from the start, so copies cost
nothing. Two fingerprints that differ in at most r bits agree on one of r + 1
blocks of bits, so every distinct fingerprint goes to r + 1 shards, one per
block value. Each shard is a BK-tree: children hang under the integer Hamming
distance to their parent, and a search follows the edges within the radius of
the query's own distance. Each shard's tree goes to the one task that asks
it, instead of to all tasks, as a tree of all shards grows with the corpus. A
shard of more than ``SHARD_ROWS`` fingerprints is dealt out again by blocks of
its remaining bits, as often as it takes: the rest of the bits then differ in
r at most as well, so no link is lost. More than that many distinct
fingerprints mostly differ from their middle in over r bits, so a level
keeps a good third of them in each of its shards.

Within a shard the tree's links are reduced to one (member, smallest member)
row per fingerprint, never to all pairs; the rows of all shards are joined up
by connected components.

Defined cases: a null text counts as empty; no words give fingerprint zero,
linked like any other; null doc_ids keep their fingerprint and never are a
group's smallest id (null if a group has no other); repeated rows give
repeated results; columns besides doc_id and text are ignored by
``fingerprints`` and kept by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import materialize, pick
from kairos.llm.graph import components
from kairos.session import let_workers_import

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, SEED, BITS = 3, 42, 3
PART = 50_000        # shingles hashed at a time
SHARD_ROWS = 4_096   # a larger shard is dealt out again
LEAF = 48            # a subtree of so few fingerprints is compared directly


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n:].tolist()
    digest, set_bits = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for lo in range(0, n, PART):
        raw = b"".join([digest(line[s:e], seed) for s, e in zip(first[lo:lo + PART], last[lo:lo + PART])])
        set_bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row."""
    def work(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})
    return pick(docs, "doc_id", "text").mapInPandas(work, "doc_id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _blocks(n: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of ``parts`` blocks that cover n bits."""
    edge = [n * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edge, edge[1:])]


def _finer(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` blocks of its free bits added, as signed longs."""
    free = [i for i in range(64) if not mask >> i & 1]
    out = [mask | sum(1 << i for i in free[lo:lo + width]) for lo, width in _blocks(len(free), parts)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def bk_links(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of some distinct fingerprints the smallest one (by position) that links within ``radius`` lead to.

    The tree is walked while it is built: a node is a pivot and its members by
    distance; the queries that reach it follow the edges within the radius of
    their own distance to the pivot. Links become a union at once.
    """
    everyone = np.arange(len(fps))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(everyone, everyone)]
    while todo:
        members, queries = todo.pop()
        if len(members) <= LEAF:
            near = np.bitwise_count(fps[queries][:, None] ^ fps[members][None, :]) <= radius
            some = near.any(axis=1)
            pairs.append((queries[some], members[near[some].argmax(axis=1)]))
            # members that one query is near to are linked; equal sets of them count once
            for code in np.unique(near.astype(np.uint64) @ (np.uint64(1) << np.arange(len(members), dtype=np.uint64))):
                together = members[[i for i in range(len(members)) if int(code) >> i & 1]]
                if len(together) > 1:
                    pairs.append((together[1:], np.repeat(together[:1], len(together) - 1)))
            continue
        pivot, members = members[0], members[1:]
        to_members = np.bitwise_count(fps[members] ^ fps[pivot])
        to_queries = np.bitwise_count(fps[queries] ^ fps[pivot]).astype(int)
        close = queries[to_queries <= radius]
        pairs.append((close, np.repeat(pivot, len(close))))
        for distance in np.unique(to_members):
            follow = queries[np.abs(to_queries - int(distance)) <= radius]
            if len(follow):
                todo.append((members[to_members == distance], follow))
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    root = everyone.copy()
    while True:  # smallest position along the links, with jumps
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def links(distinct_fps: DataFrame, bits: int = BITS) -> DataFrame:
    """``a``, ``b``: per shard, each linked fingerprint and its smallest reachable one. ``distinct_fps`` has ``fp``, without repeats.

    A shard is a mask of agreed bits and their values. The masks at hand are
    few (bits + 1 choices a level, at most seven levels until the free bits
    can't hold ``SHARD_ROWS`` fingerprints), whatever the corpus holds.
    """
    let_workers_import(distinct_fps.sparkSession)
    spark = distinct_fps.sparkSession
    todo, masks, ready = distinct_fps.select("fp", F.lit(0).cast("long").alias("mask")), [0], None
    while masks:
        finer = spark.createDataFrame([(m, _finer(m % (1 << 64), bits + 1)) for m in masks], "mask long, finer array<long>")
        shards = todo.join(F.broadcast(finer), "mask").select("fp", F.explode("finer").alias("mask"))
        shards = materialize(shards.withColumn("shard", F.col("fp").bitwiseAND(F.col("mask"))), "shards")
        sizes = materialize(shards.groupBy("mask", "shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        sized = shards.join(sizes, ["mask", "shard"])
        # a shard whose free bits may all differ is linked throughout
        large = (F.col("n") > SHARD_ROWS) & (F.bit_count("mask") < 64 - bits)
        small = sized.where(~large).select("fp", "mask", "shard")
        ready = small if ready is None else ready.unionByName(small)
        todo = sized.where(large).select("fp", "mask").distinct()
        masks = [r["mask"] for r in sizes.where(large).select("mask").distinct().collect()]
    key = ["mask", "shard"]
    dealt = ready.repartition(*key).sortWithinPartitions(*key)

    def work(batches):
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            k = b[key].to_numpy()
            new = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1
            if not len(new):
                held = b
                continue
            held = b.iloc[new[-1]:]
            yield _tree_rows(b.iloc[: new[-1]], np.concatenate(([0], new)), bits)
        if held is not None and len(held):
            k = held[key].to_numpy()
            new = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1
            yield _tree_rows(held, np.concatenate(([0], new, [len(held)])), bits)
    return dealt.mapInPandas(work, "a long, b long")


def _tree_rows(rows: pd.DataFrame, edges: np.ndarray, bits: int) -> pd.DataFrame:
    fps = rows["fp"].to_numpy()
    a, b = [], []
    for lo, hi in zip(edges, edges[1:]):
        own = np.sort(fps[lo:hi])
        if len(own) == 2:
            if int(np.bitwise_count(np.bitwise_xor(own[:1].view(np.uint64), own[1:].view(np.uint64)))[0]) <= bits:
                a.append(own[1:])
                b.append(own[:1])
        elif len(own) > 2:
            root = bk_links(own.view(np.uint64), bits)
            linked = np.flatnonzero(root != np.arange(len(own)))
            a.append(own[linked])
            b.append(own[root[linked]])
    empty = np.empty(0, np.int64)
    return pd.DataFrame({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})


def groups(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp``, ``root`` (smallest fingerprint reachable) and ``component_id`` for every distinct fingerprint of ``prints``."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), bits))
    node = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = node.groupBy("root").agg(F.min("least").alias("component_id"))
    return node.join(ids, "root").select("fp", "root", "component_id")


def classes(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    return prints.join(groups(prints, bits), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with one row of each group: the one with the smallest doc_id.

    Rows of that doc_id that differ are settled by the smallest hash of all
    their columns; a group without any doc_id keeps the row with the smallest
    hash. Columns stay as they are.
    """
    let_workers_import(docs.sparkSession)
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc, text = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    marked = flat.withColumns({"row_doc": doc, "row_hash": F.xxhash64(*flat.columns)})

    def work(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["row_doc"].astype("Int64"), "row_hash": b["row_hash"], "fp": fps.view(np.int64)})
    prints = materialize(marked.select("row_doc", "row_hash", text.alias("text")).mapInPandas(
        work, "doc_id long, row_hash long, fp long"), "fingerprints")
    first = prints.join(groups(prints, bits), "fp").groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("kept"))
    kept = materialize(first.select(F.col("kept.doc_id").alias("kept_doc"), F.col("kept.row_hash").alias("kept_hash")), "kept")
    rows = marked.join(kept, F.col("row_hash").eqNullSafe(F.col("kept_hash")) & F.col("row_doc").eqNullSafe(F.col("kept_doc")),
                       "left_semi")
    # rows that agree in every column
    return rows.dropDuplicates(["row_hash", "row_doc"]).select(flat.columns).toDF(*docs.columns)
