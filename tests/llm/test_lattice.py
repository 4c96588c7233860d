import numpy as np
import pytest

from kairos.llm import lattice as L

SCHEMA = "vec_id long, embedding array<float>, Embedding string, gid int, label int"


def brute(rows, cosine=0.95):
    """vec_id -> (n_links, component_id) by all pairs."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    vecs = {}
    for i, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(x != 0 for x in v)
        if i is not None and ok:
            own = tuple(float(np.float32(x)) for x in v)
            vecs[i] = min(vecs.get(i, own), own)
    width = max(map(len, vecs.values()), default=0)
    used = sorted(vecs)
    x = np.array([np.pad(vecs[i], (0, width - len(vecs[i]))) for i in used]).reshape(len(used), width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root = np.arange(len(used))
    while len(used):
        new = np.minimum(root, np.where(near, root[None, :], len(used)).min(axis=1))
        if (new == root).all():
            break
        root = new
    out = {i: (0, i) for i in ids}
    out |= {i: (int(near[k].sum()), used[root[k]]) for k, i in enumerate(used)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 3, 0) for i, v in rows], SCHEMA)


def result(spark, rows):
    out = L.dedup(table(spark, rows)).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return out, {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}


def clusters(seed, n=300, d=64):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for lo, hi, noise in ((0, 60, 0.02), (60, 90, 0.0), (90, 120, 0.016), (120, 128, 0.004), (132, 138, 0.01)):
        x[lo:hi] = x[lo] + r.normal(size=(hi - lo, d)) * noise
    x[130] = 3 * x[131]  # the same direction
    order = r.permutation(n)
    return [(int(order[i]), x[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)  # homes in several blocks
    rows = clusters(seed)
    out, got = result(spark, rows)
    want = brute(rows)
    assert len(out) == len(rows) and max(n for n, _ in want.values()) > 20
    assert got == want


def test_odd_rows(spark):
    rows = clusters(3, n=140)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] + [1.0] * 63), (1004, [None] * 64),
             (1005, [float("inf")] * 64), (None, [1.0] * 64), (None, None), (1006, [1.0]), (1007, [1.0, 0.0]), rows[0], rows[0],
             (1008, [1e-30] * 64), (1009, [3e30] * 64), (rows[5][0], None)]
    out, got = result_with_null(spark, rows)
    assert got == brute(rows) | {None: (0, None)}
    assert [r["kept"] for r in out if r["vec_id"] is None] == [True]
    assert L.dedup(table(spark, [])).collect() == []
    assert {r["vec_id"]: r["n_links"] for r in L.dedup(table(spark, [(5, None), (6, [2.0])])).collect()} == {5: 0, 6: 0}


def result_with_null(spark, rows):
    out = L.dedup(table(spark, rows)).collect()
    assert len(out) == len({r["vec_id"] for r in out})
    return out, {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}


def test_many_equal_vectors(spark):
    same = [1.0, 2.0] + [0.5] * 30
    rows = [(i, same) for i in range(400)] + [(400 + i, np.random.default_rng(i).normal(size=32).tolist()) for i in range(50)]
    rows.append((900, [1.0, 2.01] + [0.5] * 30))
    assert result(spark, rows)[1] == brute(rows)


def test_decoding_is_nearest():
    r = np.random.default_rng(0)
    y = r.normal(size=(2000, 8)) * 3
    points = L.decode(y)
    doubled = np.rint(2 * points).astype(int)
    assert np.allclose(doubled / 2, points)
    assert (np.ptp(doubled % 2, axis=1) == 0).all() and (doubled.sum(axis=1) % 4 == 0).all()  # all whole or all half, even sums
    own = ((y - points) ** 2).sum(axis=1)
    for step in L.shortest():
        assert (((y - points - step) ** 2).sum(axis=1) >= own - 1e-9).all()
    steps = L.shortest()
    assert len(steps) == 240 == len(np.unique(steps, axis=0)) and np.allclose((steps ** 2).sum(axis=1), 2)


@pytest.mark.parametrize("blocks", [2, 3])
def test_recall_at_the_threshold(blocks):
    r = np.random.default_rng(7)
    a, z = r.normal(size=(2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * z  # as far apart as links get
    tables = L.Tables(64, blocks, round(L.TABLES * L.MORE ** (blocks - 2)))
    (own_a, asked_a), (own_b, asked_b) = tables.cells(a), tables.cells(b)
    hit = np.zeros(len(a), bool)
    for t in range(own_a.shape[1]):
        s = slice(t * L.PROBES, (t + 1) * L.PROBES)
        hit |= (own_a[:, t] == own_b[:, t]) | (own_a[:, [t]] == asked_b[:, s]).any(axis=1) | (own_b[:, [t]] == asked_a[:, s]).any(axis=1)
    assert hit.mean() > 0.97
    assert L.shape(50_000)[0] == 2 < L.shape(10**7)[0] <= L.shape(10**10)[0]
