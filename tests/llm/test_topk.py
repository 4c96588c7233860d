import math
import random

import numpy as np
import pytest

from kairos.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, gid int, label int"


def brute(rows, every, k, scale):
    vecs = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(scale * float(np.float32(x))) for x in v]
        vecs[i] = min(vecs.get(i, w), w)
    out = []
    for q, a in vecs.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vecs.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def data(seed, n, d=10):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, r.choice([.2, 1, 3])) for _ in range(d)]) for i in range(n)]
    same = [0.5] * d
    rows += [(i, same) for i in range(n, n + 60)]                    # copies and ties
    rows += [(n + 70, None), (n + 71, []), (n + 72, [None] * d), (n + 73, [float("nan")] * d), (n + 74, [float("inf")] + [0.0] * (d - 1)),
             (n + 75, [0.0] * d), (n + 80, [0.0] * d), (None, same), (n + 90, [1.0, 2.0]), (3, [9.0] * d), rows[5], rows[5]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(T, "BLOCK", 40)
    monkeypatch.setattr(T, "QUERY_BLOCK", 7)
    monkeypatch.setattr(T, "STEPS", (2, 5))
    rows = data(seed, 300)
    got = T.search(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), every=5, k=8).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 5, 8, 64.0)


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, 1), (7, [1.0, 1.0], 1, 1)], SCHEMA)
    assert [tuple(r) for r in T.search(df).collect()] == [(0, 1, 7, 64 * 64 * 3)]
    assert T.search(df.limit(0)).count() == 0


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(0)
    c = np.floor(r.normal(size=(500, 32)) * np.linspace(8, .2, 32) * 20)
    q = np.floor(r.normal(size=(20, 32)) * np.linspace(8, .2, 32) * 20)
    rotation = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    scores = q @ c.T
    theta = np.sort(scores, axis=1)[:, -10]
    i, j, s = T.best_in_block(q, theta, c, np.arange(500), rotation, 10)
    assert {(a, b) for a, b in zip(i, j)} == {(a, b) for a in range(20) for b in np.argsort(-scores[a], kind="stable")[:10]}
    assert (s == scores[i, j]).all()
