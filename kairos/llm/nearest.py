"""Approximate nearest neighbours: several shifted Hilbert orderings, windows around the queries, merge and rerank.

Each ordering projects the vectors on a few random orthonormal directions,
shifts the grid by a random vector and sorts by the Hilbert key. The rows of
all orderings are range-partitioned by (ordering, key), which gives every row
a position per ordering. A query's candidates are the rows within ``window``
positions in any ordering; they are reranked by the exact Euclidean distance.

The window is measured, not guessed: for ``SAMPLE`` queries (by hash) the true
neighbours are found by comparing them with all rows, and the window is the
offset that reaches a ``TARGET`` share of them in their best ordering. Data
with structure get small windows; data without any (independent directions in
64 dimensions) need windows that grow with the rows, as no ordering can keep
their neighbours together.

Windows are counted in positions of distinct vectors: equal vectors are one,
with their smallest ids, so that a vector that a third of the rows share
fills no window, and all candidates and queries of a block are bounded.

Defined cases: see ``vectors.usable`` for rows left out, and zero vectors take
no part; shorter vectors are filled up with zeros; a query with fewer than k
candidates found gets those; ties go to smaller ids; columns besides vec_id
and embedding are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairos.llm import vectors as V
from kairos.llm.common import materialize

ORDERINGS, DIRECTIONS, GRID_BITS = 16, 6, 10
BLOCK = 2_048
SAMPLE, TARGET = 128, 0.96
MIN_WINDOW = 64
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of grid cells (rows of unsigned integers below 2^bits), by Skilling's transpose form."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        mask = q - one
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & mask)
            x[0] = np.where(up, x[0] ^ mask, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), one << np.uint64(bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - one), flip)
        q >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | x[i] >> np.uint64(b) & one
    return key.astype(np.int64)  # below 2^60


class Orderings:
    """The directions, scales and shifts of all orderings; a function of the seed and the data's moments alone."""

    def __init__(self, mean: np.ndarray, second: np.ndarray):
        r = np.random.default_rng(SEED)
        d = len(mean)
        cov = second - np.outer(mean, mean)
        self.mean, self.parts = mean, []
        m = min(DIRECTIONS, d)
        for _ in range(ORDERINGS):
            axes = np.linalg.qr(r.normal(size=(d, d)))[0][:, :m]
            spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", axes, cov, axes), 1e-12))
            self.parts.append((axes, spread, r.uniform(0, 0.25, m)))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Rows by orderings; four spreads to either side fill three quarters of the grid, the shift moves within the rest."""
        out = np.empty((len(x), ORDERINGS), np.int64)
        for t, (axes, spread, shift) in enumerate(self.parts):
            unit = np.clip(((x - self.mean) @ axes / spread + 4) / 8, 0, 1) * 0.75 + shift
            out[:, t] = hilbert_keys(np.minimum(unit * (1 << GRID_BITS), (1 << GRID_BITS) - 1).astype(np.uint64), GRID_BITS)
        return out


def positions(groups: DataFrame, orderings: Orderings, width: int, n: int) -> DataFrame:
    """``ordering``, ``pos``, ``gid``, ``vec``: every distinct vector's place in every ordering."""
    def keys(batches):
        for b in batches:
            k = orderings.keys(V.matrix(b["vec"], width))
            for t in range(ORDERINGS):
                yield pd.DataFrame({"ordering": t, "key": k[:, t], "gid": b["gid"], "vec": b["vec"]}).astype({"ordering": "int32"})
    keyed = groups.select("gid", "vec").mapInPandas(keys, "ordering int, key long, gid long, vec array<double>")
    parts = max(ORDERINGS, -(-n * ORDERINGS // (16 * BLOCK)))
    dealt = keyed.repartitionByRange(parts, "ordering", "key", "gid").sortWithinPartitions("ordering", "key", "gid")

    def number(batches):
        from pyspark import TaskContext
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            at = np.empty(len(b), np.int64)
            for t, rows in b.groupby("ordering", sort=False).indices.items():
                at[rows] = seen.get(t, 0) + np.arange(len(rows))
                seen[t] = seen.get(t, 0) + len(rows)
            yield pd.DataFrame({"part": part, "ordering": b["ordering"], "place": at, "gid": b["gid"], "vec": b["vec"]})
    numbered = materialize(dealt.select("ordering", "gid", "vec").mapInPandas(
        number, "part int, ordering int, place long, gid long, vec array<double>"), "orderings")
    # one row per partition and ordering
    counts = numbered.groupBy("ordering", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("ordering", "part", (F.sum("n").over(Window.partitionBy("ordering").orderBy("part")) - F.col("n")).alias("before"))
    return numbered.join(before, ["ordering", "part"]).select("ordering", (F.col("before") + F.col("place")).alias("pos"), "gid", "vec")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of ``gid``'s candidates, each once."""
    once = rows.groupBy("gid", "cand").agg(F.min("score").alias("score"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("gid").orderBy("score", "cand"))).where(F.col("place") <= k)


def nearest(q: np.ndarray, c: np.ndarray, allowed, ids: np.ndarray, k: int):
    """(query row, candidate row, distance) of the k nearest allowed candidates per query, by exact distances."""
    rough = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * q @ c.T
    if allowed is not None:
        rough[~allowed] = np.inf
    take = min(len(c), k + 8)  # rounding of the rough form can't move one of the k beyond so many, but near-ties may
    part = np.argpartition(rough, take - 1, axis=1)[:, :take] if take < len(c) else np.broadcast_to(np.arange(len(c)), (len(q), len(c)))
    limit = np.take_along_axis(rough, part, 1).max(axis=1)
    scale = 1e-9 * (1 + np.abs((q * q).sum(1)) + np.abs((c * c).sum(1)).max(initial=0))
    rows, cols, score = [], [], []
    for i in range(len(q)):
        own = part[i]
        if np.isfinite(limit[i]):
            own = np.flatnonzero(rough[i] <= limit[i] + scale[i])
        own = own[np.isfinite(rough[i, own])]
        d = np.sqrt(((c[own] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[own], d))[:k]
        rows.append(np.full(len(best), i))
        cols.append(own[best])
        score.append(d[best])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(score)


def window(places: DataFrame, groups: DataFrame, queries: DataFrame, width: int, k: int) -> int:
    """The offset that reaches TARGET of the true neighbours of the sampled queries."""
    sample = queries.join(groups.select("gid", "vec"), "gid").orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).toPandas()
    q, q_ids = V.matrix(sample["vec"], width), sample["gid"].to_numpy()

    def compare(batches):
        for b in batches:
            ids = b["gid"].to_numpy()
            i, j, d = nearest(q, V.matrix(b["vec"], width), ids[None, :] != q_ids[:, None], ids, k)
            yield pd.DataFrame({"gid": q_ids[i], "cand": ids[j], "score": d})
    true = materialize(_top(groups.select("gid", "vec").mapInPandas(compare, "gid long, cand long, score double"), k), "neighbours")
    at = places.select("ordering", "gid", "pos")
    offset = (true.join(at, "gid").join(at.select("ordering", F.col("gid").alias("cand"), F.col("pos").alias("cand_pos")), ["ordering", "cand"])
              .groupBy("gid", "cand").agg(F.min(F.abs(F.col("pos") - F.col("cand_pos"))).alias("offset")))
    # SAMPLE * k offsets at most
    found = sorted(r["offset"] for r in offset.select("offset").collect())
    return max(MIN_WINDOW, int(found[min(len(found) - 1, int(TARGET * len(found)))])) if found else MIN_WINDOW


def search(rows: DataFrame, every: int = 100, k: int = 10, window_size: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (distance): each query's k nearest found (queries: ids divisible by ``every``)."""
    keep = k + 1
    nonzero = V.usable(rows).where(F.exists("vec", lambda x: x != 0))
    whole = materialize(nonzero, "vectors")
    groups = materialize(V.distinct(whole, keep), "groups")
    members = V.members_of(whole, groups, every)
    n, mean, second = V.moments(groups)
    if n == 0:
        return V.ranked(groups.select("gid", F.lit(0.0).alias("score"), "ids"), members, F.asc("score"), k)
    width = len(mean)
    places = materialize(positions(groups, Orderings(mean, second), width, n), "places")
    queries = members.select("gid").distinct()
    w = window(places, groups, queries, width, k) if window_size is None else window_size
    asked = places.join(queries, "gid", "left_semi").select(
        "ordering", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("pos") - w) / BLOCK), F.floor(
            F.least(F.lit(n - 1), F.col("pos") + w) / BLOCK))).alias("block"), "pos", "gid", "vec")
    blocks = places.select(F.col("ordering").alias("own_ordering"), F.floor(F.col("pos") / BLOCK).alias("own_block"),
                           F.col("pos").alias("own_pos"), F.col("gid").alias("cand"), F.col("vec").alias("cand_vec"))

    def meet(asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block):
            c, ids, at = V.matrix(block["cand_vec"], width), block["cand"].to_numpy(), block["own_pos"].to_numpy()
            for lo in range(0, len(asking), 512):
                part = asking.iloc[lo:lo + 512]
                inside = np.abs(part["pos"].to_numpy()[:, None] - at[None, :]) <= w
                i, j, d = nearest(V.matrix(part["vec"], width), c, inside, ids, keep)
                out.append(pd.DataFrame({"gid": part["gid"].to_numpy()[i], "cand": ids[j], "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"gid": [], "cand": [], "score": []}).astype({"gid": "int64", "cand": "int64", "score": "float64"})
    # a block has BLOCK rows, and asking it at most as many distinct queries as lie within a window of it
    found = asked.groupBy("ordering", "block").cogroup(blocks.groupBy("own_ordering", "own_block")).applyInPandas(
        meet, "gid long, cand long, score double")
    best = _top(found, keep).join(groups.select(F.col("gid").alias("cand"), "ids"), "cand")
    return V.ranked(best.select("gid", "score", "ids"), members, F.asc("score"), k)
