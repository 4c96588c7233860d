"""Exact top-k by inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Candidates are range-partitioned by length and packed into blocks, longest
first. The first block, whose size is fixed, is broadcast and gives every
query a score to beat. A query block then meets only the candidate blocks
whose longest vector, times a query's length, can still reach that score;
lengths have classes (eighths of a power of two), so these blocks are found by
an equi-join on the classes at or above the one needed. Inside, both sides
are rotated so that the first coordinates carry most of the length (the right
singular vectors of the candidates); after some of them the sum so far plus
the product of the remaining lengths bounds the score. Bounds are taken on
whole blocks of sums; once few pairs are left, only those go on. Survivors are
scored in integers. A bound is never below the true score (it has a margin
for rounding) and ties are kept, so the result is exact.

Candidate blocks are shuffled once; the smaller query blocks go to them. Both
travel as packed numbers.

Components x become floor(scale * x). Scores must stay below 2^53.

Defined cases: see ``vectors.usable`` for rows left out; vectors of different
lengths are filled up with zeros; a query with fewer than k candidates gets
all; equal vectors are searched once; ties go to smaller ids; columns besides
vec_id and embedding are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.llm import vectors as V
from kairos.llm.common import materialize

BLOCK = 4_096         # candidates per block
QUERY_BLOCK = 512
STEPS = (8, 24)       # coordinates summed before a bound is taken
FEW = 0.05            # share of pairs that are scored one by one
MARGIN = 1e-6         # relative, on bounds in floating point
SHORTEST = -10_000    # class of length 0


def best_in_block(q: np.ndarray, theta: np.ndarray, c: np.ndarray, ids: np.ndarray, rotation: np.ndarray, keep: int):
    """(query row, candidate row, score) of at most ``keep`` best candidates per query that reach ``theta``; ties to smaller ids."""
    rq, rc = q @ rotation, c @ rotation
    slack = MARGIN * (1 + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])
    live, sums, done = None, np.zeros((len(q), len(c))), 0
    for upto in STEPS:
        upto = min(upto, rq.shape[1])
        sums += rq[:, done:upto] @ rc[:, done:upto].T
        rest = np.linalg.norm(rq[:, upto:], axis=1)[:, None] * np.linalg.norm(rc[:, upto:], axis=1)[None, :]
        live, done = sums + rest + slack >= theta[:, None], upto
        if live.mean() <= FEW:
            break
    if live.mean() <= FEW:
        rows, cols = np.nonzero(live)
        score = np.empty(len(rows))
        for lo in range(0, len(rows), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            score[part] = np.einsum("ij,ij->i", q[rows[part]], c[cols[part]])
        reach = score >= theta[rows]
        rows, cols, score = rows[reach], cols[reach], score[reach]
    else:
        whole = q @ c.T  # whole numbers below 2^53: exact in any order
        limit = theta
        if len(c) > keep:
            limit = np.maximum(theta, np.partition(whole, len(c) - keep, axis=1)[:, len(c) - keep])
        rows, cols = np.nonzero(whole >= limit[:, None])
        score = whole[rows, cols]
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    first = np.searchsorted(rows, rows)
    top = np.arange(len(rows)) - first < keep
    return rows[top], cols[top], score[top]


def length_class(length: Column) -> Column:
    """A whole number that grows with the length, eight to a power of two."""
    return F.when(length > 0, F.floor(F.log2(length) * 8)).otherwise(SHORTEST).cast("int")


def _pack(rows: DataFrame, size: int, width: int, name: str) -> DataFrame:
    """Sorted rows to blocks of at most ``size``: ids and vectors as packed numbers; ``length`` is the longest in a block."""
    def work(batches):
        for b in batches:
            for lo in range(0, len(b), size):
                part = b.iloc[lo:lo + size]
                yield pd.DataFrame([{"gids": part["gid"].to_numpy(np.int64).tobytes(), "vecs": V.matrix(part["vec"], width).tobytes(),
                                     "length": float(part["length"].max())}])
    packed = rows.select("gid", "vec", "length").mapInPandas(work, "gids binary, vecs binary, length double")
    return materialize(packed.withColumn("block", F.monotonically_increasing_id()), name)


def _unpack(gids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(gids, np.int64)
    return ids, np.frombuffer(vecs, np.float64).reshape(len(ids), -1)


def search(rows: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k best candidates (queries: ids divisible by ``every``)."""
    keep = k + 1
    whole = materialize(V.usable(rows, lambda v: F.transform(v, lambda x: F.floor(x * scale).cast("double"))), "vectors")
    groups = materialize(V.distinct(whole, keep), "groups")
    members = V.members_of(whole, groups, every)
    n, _, second = V.moments(groups)
    if n == 0:
        return V.ranked(groups.select("gid", F.lit(0).cast("long").alias("score"), "ids"), members, F.desc("score"), k)
    rotation = np.linalg.eigh(second)[1][:, ::-1]  # right singular vectors, by descending singular value
    width = len(rotation)
    sized = groups.withColumn("length", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    parts = max(1, -(-n // BLOCK))
    candidates = _pack(sized.repartitionByRange(parts, F.desc("length"), "gid").sortWithinPartitions(F.desc("length"), "gid"),
                       BLOCK, width, "candidates")
    asked = sized.join(members.select("gid").distinct(), "gid", "left_semi")
    queries = _pack(asked.repartitionByRange(max(1, -(-n // (QUERY_BLOCK * every))), F.desc("length"), "gid")
                    .sortWithinPartitions(F.desc("length"), "gid"), QUERY_BLOCK, width, "queries")
    # the longest candidates, BLOCK at most, whatever the input
    head = [tuple(r) for r in sized.orderBy(F.desc("length"), "gid").limit(BLOCK).select("gid", "vec").collect()]
    head_ids = np.array([g for g, _ in head], np.int64)
    head_vecs = V.matrix(pd.Series([v for _, v in head]), width)

    def aim(batches):
        for b in batches:
            for gids, vecs, block in zip(b["gids"], b["vecs"], b["block"]):
                _, q = _unpack(gids, vecs)
                got, _, score = best_in_block(q, np.full(len(q), -np.inf), head_vecs, head_ids, rotation, keep)
                theta = np.full(len(q), -np.inf)
                for i in np.unique(got):
                    own = score[got == i]
                    if len(own) == keep:
                        theta[i] = own[-1]
                length = np.linalg.norm(q, axis=1)
                # the shortest candidate length that some query of the block can use
                need = np.where(length > 0, theta / np.where(length > 0, length, 1), np.where(theta > 0, np.inf, -np.inf)).min(initial=np.inf)
                yield pd.DataFrame([{"query_block": block, "gids": gids, "vecs": vecs, "theta": theta.tobytes(), "need": float(need)}])
    aimed = materialize(queries.mapInPandas(
        aim, "query_block long, gids binary, vecs binary, theta binary, need double"), "aimed")
    reach = candidates.select("block", "length", length_class(F.col("length")).alias("class"))
    # classes that occur: lengths of doubles have 17,000 at most
    classes = F.array(*[F.lit(r["class"]) for r in reach.select("class").distinct().orderBy("class").collect()])
    # each query block by the classes it needs, lowered by one for rounding; then by the blocks of those
    wanted = aimed.withColumn("from_class", length_class(F.col("need")) - 1).select(
        "query_block", "need", F.explode(F.filter(classes, lambda x: x >= F.col("from_class"))).alias("class"))
    pairs = wanted.join(reach, "class").where(F.col("length") * (1 + MARGIN) + MARGIN >= F.col("need")).select("query_block", "block")
    both = (pairs.join(aimed.drop("need"), "query_block").repartition("block", "query_block")
            .join(candidates.select("block", F.col("gids").alias("cand_gids"), F.col("vecs").alias("cand_vecs")), "block"))

    def meet(batches):
        for b in batches:
            for gids, vecs, theta, cand_gids, cand_vecs in zip(b["gids"], b["vecs"], b["theta"], b["cand_gids"], b["cand_vecs"]):
                (own, q), (ids, c) = _unpack(gids, vecs), _unpack(cand_gids, cand_vecs)
                i, j, score = best_in_block(q, np.frombuffer(theta, np.float64), c, ids, rotation, keep)
                yield pd.DataFrame({"gid": own[i], "cand": ids[j], "score": score.astype(np.int64)})
    found = both.mapInPandas(meet, "gid long, cand long, score long")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("score"), "cand"))).where(
        F.col("place") <= keep).join(groups.select(F.col("gid").alias("cand"), "ids"), "cand")
    return V.ranked(best.select("gid", "score", "ids"), members, F.desc("score"), k)
