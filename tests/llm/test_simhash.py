import random
import re

import numpy as np
import xxhash

from kairos.llm import graph, simhash
from kairos.llm.queries import op10_simhash


def brute_fp(text):
    t = re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_groups(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def planted(n, seed):
    """Fingerprints in clouds, with chains of near ones."""
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 3, 20])):
            out.add(f)
            for _ in range(r.randint(1, 5)):
                f ^= 1 << r.randrange(64)
    return sorted(out)


def test_tree_equals_brute_force():
    for seed in range(4):
        fps = planted(400, seed)
        got = simhash.bk_links(np.array(fps, np.uint64), 3)
        assert got.tolist() == brute_groups(fps)


def test_links_over_shards_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)  # so that large shards are dealt out again
    fps = planted(300, 9) + [x << 16 | 5 for x in range(60)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.groups(prints).collect()}
    assert [got[f] for f in signed] == brute_groups(fps)


def test_dense_cluster_is_dealt_until_bounded(spark, monkeypatch):
    """Thousands of fingerprints around one middle: more than one level of dealing, and no task holds a larger shard."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    r = random.Random(4)
    middle = r.getrandbits(64)
    fps = {middle} | {middle ^ (1 << a | 1 << b | 1 << c | 1 << d) for a, b, c, d in
                      (r.sample(range(64), 4) for _ in range(600))}
    fps = sorted(fps | {f ^ (1 << 50) for f in planted(80, 2)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    levels = []
    deal = simhash._finer
    monkeypatch.setattr(simhash, "_finer", lambda mask, parts: levels.append(mask.bit_count()) or deal(mask, parts))
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {row["fp"]: row["component_id"] for row in simhash.groups(prints).collect()}
    assert [got[f] for f in signed] == brute_groups(fps)
    assert len(set(levels)) > 2 and levels[0] == 0


def test_finer_masks_cover_the_free_bits():
    for mask in (0, 0xFFFF, 0xFFFF << 48 | 0xFFF, (1 << 61) - 1):
        parts = [m % (1 << 64) & ~mask for m in simhash._finer(mask, 4)]
        assert sum(parts) == (1 << 64) - 1 - mask and all(a & b == 0 for i, a in enumerate(parts) for b in parts[:i])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [(5, "The quick  brown fox jumps"), (3, "the QUICK brown\tfox jumps"), (9, None), (8, ""), (4, "  \n"), (7, "one"),
        (7, "one"), (None, "lonely words of nobody here"), (12, "two words"), (11, "x " * 60_000), (13, "Ünï " * 10)]


def test_query_equals_brute_force(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, fp int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"] or -1), r["fingerprint"], r["component_id"]) for r in op10_simhash(spark, str(tmp_path)).collect())
    fps = [brute_fp(t) for _, t in ROWS]
    root = brute_groups(fps)
    ids = {g: min((d for (d, _), x in zip(ROWS, root) if x == g and d is not None), default=None) for g in root}
    assert got == sorted(((d or -1), f"{f:016x}", ids[g]) for (d, _), f, g in zip(ROWS, fps, root))


def test_keep_one_row_of_each_group(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, row_hash int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 3, 4, 7, 11, 12, 13]
    assert simhash.keep_one(df.limit(0)).count() == 0
