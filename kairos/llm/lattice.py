"""Embedding near-duplicates: lattice hashing with E8, neighbouring cells probed, cosine verified.

Hashing. Unit vectors are projected on 8 random directions for each of
``blocks`` E8 lattices and decoded to the nearest lattice points; the points
together are the cell. Each of several tables has directions and a shift of
its own. In every table a vector lies in its own cell and also asks the
``PROBES`` cells that its remainder points to most (own point plus one of the
240 shortest lattice vectors in one block). The more vectors, the more lattice
blocks a cell has, so that what meets by chance stays bounded per vector; and
the more tables, so that what is found does not fall (``shape``).

Links without pairs. A vector's cell in the first table is its home, and each
vector has exactly one. The tables only say which homes have vectors that met;
every two such homes are then compared in full, each two vectors once, in
blocks of at most about ``BLOCK`` vectors. A comparison puts out, per vector,
its number of links and the smallest vector linked inside the two blocks, so
a group of near copies is never listed pair by pair; components join them up.
Equal vectors are one node with a count from the start.

Every link put out has a verified cosine of at least ``COSINE``; pairs may be
missed with the small chance that no table brings them together.

Defined cases: see ``vectors.usable`` for vectors that take no part; those and
zero vectors link with nothing and are their own component. Shorter vectors
are filled up with zeros. Rows that share an id are one, a null id too: it
has no component and is kept. Columns besides vec_id and embedding are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm import vectors as V
from kairos.llm.common import materialize, pick
from kairos.llm.graph import components

COSINE = 0.95
SPREAD = 0.6            # standard deviation of a unit vector's projections, in lattice units
CHANCE = 1.5e-3         # that two unrelated vectors share a point of one lattice
MET = 20                # vectors that a vector may meet by chance, over all tables
PROBES = 3
TABLES, MORE = 12, 2     # with two lattices, and the factor for each further one
BLOCK = 512
ROWS = 4_096            # decoded at a time
SEED = 23


def shape(n: int) -> tuple[int, int]:
    """Lattice blocks per cell and tables for n vectors."""
    blocks = 2
    while n * TABLES * MORE ** (blocks - 2) * (1 + 2 * PROBES) * CHANCE ** blocks > MET:
        blocks += 1
    return blocks, round(TABLES * MORE ** (blocks - 2))


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    whole = np.zeros((112, 8))
    for row, ((i, j), (a, b)) in zip(whole, [(ij, ab) for ij in combinations(range(8), 2) for ab in ((1, 1), (1, -1), (-1, 1), (-1, -1))]):
        row[[i, j]] = a, b
    signs = 1 - 2 * (np.arange(256)[:, None] >> np.arange(8) & 1)
    return np.concatenate([whole, signs[(signs < 0).sum(axis=1) % 2 == 0] / 2])


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: the coordinate farthest from its rounding gives way if the sum is odd."""
    point = np.rint(y)
    rest = y - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(axis=1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (whole points of even sum, and those moved by 1/2) to each row."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


class Tables:
    """Directions, shifts and hash weights of all tables: a function of the seed, the shape and the width alone."""

    def __init__(self, width: int, blocks: int, tables: int):
        r = np.random.default_rng(SEED)
        self.blocks, self.width = blocks, width
        self.parts = [(r.normal(size=(width, 8 * blocks)) * SPREAD, r.uniform(0, 4, 8 * blocks),
                       r.integers(1, 1 << 63, 8 * blocks, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 63, dtype=np.uint64))
                      for _ in range(tables)]
        self.steps = shortest()

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cells (rows by tables) and asked cells (rows by tables * PROBES), as hashes."""
        own = np.empty((len(x), len(self.parts)), np.int64)
        asked = np.empty((len(x), len(self.parts) * PROBES), np.int64)
        doubled = (2 * self.steps).astype(np.int64).view(np.uint64)
        for t, (directions, shift, weights, start) in enumerate(self.parts):
            y = x @ directions + shift
            points = np.concatenate([decode(y[:, 8 * b:8 * b + 8]) for b in range(self.blocks)], axis=1)
            key = (np.rint(2 * points).astype(np.int64).view(np.uint64) * weights).sum(axis=1, dtype=np.uint64) + start
            own[:, t] = key.view(np.int64)
            gain = np.concatenate([(y - points)[:, 8 * b:8 * b + 8] @ self.steps.T for b in range(self.blocks)], axis=1)
            moved = np.concatenate([(doubled * weights[8 * b:8 * b + 8]).sum(axis=1, dtype=np.uint64) for b in range(self.blocks)])
            best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
            asked[:, t * PROBES:(t + 1) * PROBES] = (key[:, None] + moved[best]).view(np.int64)
        return own, asked


def hashed(nodes: DataFrame, tables: Tables) -> DataFrame:
    """``gid``, ``copies``, ``unit`` (filled up), ``home``, ``own``, ``asked`` of every distinct vector."""
    def work(batches):
        for b in batches:
            for lo in range(0, len(b), ROWS):
                part = b.iloc[lo:lo + ROWS]
                x = V.matrix(part["vec"], tables.width)
                x /= np.abs(x).max(axis=1, keepdims=True)  # before the squares, which may overflow
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                own, asked = tables.cells(x)
                yield pd.DataFrame({"gid": part["gid"].to_numpy(), "copies": part["copies"].to_numpy(), "unit": list(x),
                                    "home": own[:, 0], "own": list(own), "asked": list(asked)})
    return nodes.select("gid", "vec", "copies").mapInPandas(
        work, "gid long, copies long, unit array<double>, home long, own array<long>, asked array<long>")


def meeting_homes(keyed: DataFrame) -> DataFrame:
    """``a``, ``b`` (a < b): homes with vectors that met in some table."""
    own = keyed.select(F.explode("own").alias("cell"), F.col("home").alias("a")).distinct()
    asked = keyed.select(F.explode("asked").alias("cell"), F.col("home").alias("b")).distinct()
    both = own.join(own.withColumnRenamed("a", "b"), "cell").where("a < b").select("a", "b").unionByName(
        own.join(asked, "cell").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return both.distinct()


def compare(one: np.ndarray, two: np.ndarray, same: bool, cosine: float):
    """Which vectors of two blocks link, and for each of both blocks the smallest position that links lead to."""
    near = one @ two.T >= cosine
    if same:
        np.fill_diagonal(near, False)
    n, m = near.shape
    # positions: the first block's, then the second's, which are the first's again if it is the same
    root = np.arange(n if same else n + m)
    at = 0 if same else n
    while near.any():
        new = root.copy()
        least_two = np.where(near, root[at:][None, :], len(root)).min(axis=1)
        new[:n] = np.minimum(new[:n], least_two)
        new[at:at + m] = np.minimum(new[at:at + m], np.where(near, new[:n][:, None], len(root)).min(axis=0))
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return near, root


def links(keyed: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``gid``, ``n_links`` (to other distinct vectors, copies counted) and ``root`` (one vector that links lead to), per block compared."""
    met = materialize(meeting_homes(keyed), "homes")
    sizes = keyed.groupBy("home").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes.select("home", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "sizes")
    pairs = met.unionByName(sizes.where("n > 1").select(F.col("home").alias("a"), F.col("home").alias("b")))
    parts = sizes.select("home", "parts")
    pairs = (pairs.join(parts.toDF("a", "a_parts"), "a").join(parts.toDF("b", "b_parts"), "b")
             .withColumn("a_part", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1)))
             .withColumn("b_part", F.explode(F.sequence(F.lit(0), F.col("b_parts") - 1)))
             .where("a < b OR a_part <= b_part").select("a", "b", "a_part", "b_part"))
    needed = met.select(F.col("a").alias("home")).unionByName(met.select(F.col("b").alias("home"))).unionByName(
        sizes.where("n > 1").select("home")).distinct()
    dealt = keyed.select("home", "gid", "copies", "unit").join(needed, "home", "left_semi").join(parts, "home")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))
    packed = dealt.groupBy("home", "part").agg(F.collect_list(F.struct("gid", "copies", "unit")).alias("v")).select(
        "home", "part", F.struct(F.col("v.gid").alias("gids"), F.col("v.copies").alias("copies"), F.flatten("v.unit").alias("units")).alias("v"))
    packed = materialize(packed, "packed")
    two = pairs.join(packed.toDF("a", "a_part", "one"), ["a", "a_part"]).join(packed.toDF("b", "b_part", "two"), ["b", "b_part"]).select(
        (F.expr("a = b AND a_part = b_part")).alias("same"), *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("one", "two") for c in ("gids", "copies", "units")])

    def work(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                gids, copies, units = ({x: np.asarray(r[f"{x}_{c}"]) for x in ("one", "two")} for c in ("gids", "copies", "units"))
                near, root = compare(units["one"].reshape(len(gids["one"]), -1), units["two"].reshape(len(gids["two"]), -1), r["same"], cosine)
                ids = gids["one"] if r["same"] else np.concatenate([gids["one"], gids["two"]])
                n_links = near @ copies["two"]
                if not r["same"]:
                    n_links = np.concatenate([n_links, copies["one"] @ near])
                some = np.flatnonzero(n_links)
                out.append((ids[some], n_links[some], ids[root[some]]))
            gid, n_links, root = (np.concatenate([o[i] for o in out]) for i in range(3))
            if len(gid):
                yield pd.DataFrame({"gid": gid, "root": root, "n_links": n_links}).groupby(["gid", "root"], as_index=False).sum()
    return two.mapInPandas(work, "gid long, root long, n_links long")


def dedup(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every id."""
    ids = pick(rows, "vec_id").distinct()
    whole = materialize(V.usable(rows).where(F.exists("vec", lambda x: x != 0)), "vectors")
    nodes = materialize(whole.groupBy("vec").agg(F.min("vec_id").alias("gid"), F.count(F.lit(1)).alias("copies")), "nodes")
    n, width = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    keyed = materialize(hashed(nodes, Tables(width, *shape(n))), "cells")
    found = materialize(links(keyed, cosine), "links")
    roots = components(found.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    told = (nodes.join(found.groupBy("gid").agg(F.sum("n_links").alias("n_links")), "gid", "left").join(roots.withColumnRenamed("node", "gid"), "gid", "left")
            .select("vec", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "gid").alias("root")))
    linked = whole.join(told, "vec").select("vec_id", "n_links", "root")
    component = F.coalesce("root", "vec_id")
    return ids.join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
