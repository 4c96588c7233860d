import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from kairos.llm import divergence as D
from kairos.llm import oracles

SCHEMA = "doc_id long, Text string, text string, lang string, source string, term string"


def corpus(seed, n=400, sources=9):
    r = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["été", "Straße", "naïve", "zzz9zzz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        text = r.choice([", ".join(r.choices(words, weights, k=r.randint(1, 60))).title(), None, "", "123 456!"]) if r.random() < .2 else \
            " ".join(r.choices(words, weights, k=r.randint(1, 60)))
        lang = r.choice(["en", "en", "en", "de", None, ""])
        rows.append((i, "clash", text, lang, r.choice(["src0"] * 4 + [f"src{k}" for k in range(1, sources)] + [None]), "x"))
    rows.append((n, "", "rare words only", "xx", "a", ""))
    rows.append((n, "", None, "xx", "b", ""))
    rows.append((n + 1, "", "common " * 50_000, "en", "long", ""))
    return rows + rows[:20]


def brute(rows, min_docs=30, top=50):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, _, text, lang, source, _ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs.keys() | {g[0] for g in counts}:
        kept = sorted(t for t, k in docs[lang].items() if k >= min_docs)
        own = {s: c for (la, s), c in counts.items() if la == lang}
        whole = sum(own.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept]
        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(sum(abs(x - y) for x, y in zip(p[s], p[o])), o) for o in own if o != s]
            terms = [(x - y, t) for x, y, t in zip(p[s], q, kept) if own[s][t] and x > y]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def got(spark, rows, **kw):
    return sorted(tuple(r) for r in D.audit(spark.createDataFrame(rows, SCHEMA), **kw).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_and_sql(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert any(r[2] == "term" for r in want)
    assert got(spark, rows) == want
    con = duckdb.connect()
    con.register("f", pd.DataFrame(rows, columns=["doc_id", "x", "text", "lang", "source", "y"]))
    con.execute("CREATE VIEW documents AS SELECT doc_id, text, lang, source FROM f")
    assert sorted(tuple(r) for r in con.execute(oracles.SOURCE_DIVERGENCE).fetchall()) == want


def test_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "SOURCES", 3)
    monkeypatch.setattr(D, "CHUNK", 7)
    monkeypatch.setattr(D, "HELD", 50)
    rows = corpus(5, n=250, sources=14)
    assert got(spark, rows, min_docs=4, top=3) == brute(rows, 4, 3)


def test_empty_table_and_texts_without_terms(spark):
    assert got(spark, []) == []
    rows = [(1, "", None, "en", "a", ""), (2, "", "12", "en", "b", ""), (3, "", "", None, None, "")]
    assert got(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_bitmaps_count_every_term_once():
    r = np.random.default_rng(0)
    for n_terms in (1, 63, 64, 130):
        counts = r.integers(0, 5, (6, n_terms))
        share = lambda c: c * 1000 + 7

        def block(groups):
            rows = defaultdict(int)
            for g in groups:
                for t, c in enumerate(counts[g]):
                    if c:
                        rows[g, share(c), t // 64] |= 1 << t % 64
            keys = list(rows)
            return D.Bitmaps(groups, [share(0)] * len(groups), [k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys],
                             np.array([rows[k] for k in keys], np.uint64).view(np.int64), n_terms)
        value = block([0, 1, 2]).divergences(block([3, 4, 5]))
        want = np.abs(share(counts[:3])[:, None] - share(counts[3:])[None]).sum(axis=2)
        assert (value == want).all()
