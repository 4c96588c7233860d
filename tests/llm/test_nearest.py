import math

import numpy as np
import pytest

from kairos.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, pos int, label int"


def brute(rows, every, k):
    vecs = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        w = [float(np.float32(x)) for x in v]
        vecs[i] = min(vecs.get(i, w), w)
    ids = sorted(vecs)
    d = max(map(len, vecs.values()))
    x = np.array([vecs[i] + [0.0] * (d - len(vecs[i])) for i in ids])
    out = {}
    for a, q in enumerate(ids):
        if q % every == 0:
            dist = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
            out[q] = sorted((s, i) for s, i in zip(dist.tolist(), ids) if i != q)[:k]
    return out


def rows_of(n, d, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(i, x[7].tolist()) for i in range(n, n + 300)]
    return rows + [(n + 400, None), (n + 401, []), (n + 402, [0.0] * d), (n + 403, [None] * d), (n + 404, [float("nan")] * d),
                   (n + 405, [float("-inf")] * d), (None, [1.0] * d), rows[5], rows[5], (5, [9.0] * d), (n + 500, [1.0])]


def run(spark, rows, **kw):
    got = {}
    for r in N.search(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), **kw).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_recall_distances_and_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 128)
    monkeypatch.setattr(N, "MIN_WINDOW", 4)
    rows = rows_of(1500, 24, 1)
    got, want = run(spark, rows, every=20, k=10), brute(rows, 20, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {q: dict((i, s) for s, i in brute(rows, 20, 10_000)[q]) for q in want}
    for q in got:
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        assert all(s == pytest.approx(exact[q][i], abs=1e-12) for s, i in got[q])
    copies = [q for q in want if 1500 <= q < 1800]
    assert copies and all(got[q] == want[q] for q in copies)


def test_a_window_over_everything_is_exact(spark):
    rows = rows_of(200, 5, 2)
    got, want = run(spark, rows, every=10, k=7, window_size=10_000), brute(rows, 10, 7)
    assert {q: [i for _, i in w] for q, w in got.items()} == {q: [i for _, i in w] for q, w in want.items()}


def test_hilbert_neighbours_are_neighbours():
    for m, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * m, indexing="ij"), -1).reshape(-1, m)
        keys = N.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path.astype(int), axis=0)).sum(axis=1) == 1).all()


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, 1), (7, [1.0, 1.0], 1, 1)], SCHEMA)
    assert [tuple(r) for r in N.search(df).collect()] == [(0, 1, 7, 1.0)]
    assert N.search(df.limit(0)).count() == 0
