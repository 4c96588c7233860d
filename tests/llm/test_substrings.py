import hashlib
import random
import re
from collections import Counter

import pytest

from kairos.llm import substrings as S


def brute(rows):
    docs = [(S.NO_ID if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for a in range(len(w) - 19):
            k = tuple(w[a:a + 20])
            first[k] = min(first.get(k, (i, a)), (i, a))
    out = []
    for (i, _), (order, w) in zip(rows, docs):
        gone = set()
        for a in range(len(w) - 19):
            if first[tuple(w[a:a + 20])] < (order, a):
                gone.update(range(a, a + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([19, 20, 21, 30, 70]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        for _ in range(r.choice([0, 0, 1, 2])):
            at = r.randint(0, len(words))
            words[at:at] = r.choice(passages)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    rows += [rows[3], rows[5], (None, rows[7][1]), (None, rows[7][1] + " x"), (n + 1, rows[9][1]), (n + 2, None), (n + 3, ""),
             (n + 4, "a b " * 60), (n + 5, "z " * 5_000), (4, rows[11][1])]
    r.shuffle(rows)
    return rows


def test_cover_holds_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "BLOCK_BYTES", 3_000)  # many blocks
    rows = corpus(seed, 90)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, block int").repartition(3)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in S.dedup(df).collect())
    assert got == Counter(brute(rows))


def test_runs_tell_what_went(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, "x y " + text + " z")], "doc_id long, text string")
    got = {r["doc_id"]: [(x["first"], x["end"]) for x in r["removed"]] for r in S.dedup(df).collect()}
    assert got == {1: [], 2: [(2, 32)]}


def test_empty_table(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string"), with_text=False).count() == 0
