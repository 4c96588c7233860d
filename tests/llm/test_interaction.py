import random
from collections import Counter
from itertools import permutations

import duckdb
import pandas as pd

from kairos.llm import interaction as I
from kairos.llm import oracles

DOCS = "doc_id long, Text string, text string, lang string, mask int"
LABELS = "doc_id long, quality int, toxic int, part string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def corpus(seed, n=120):
    r = random.Random(seed)
    texts = [None, "", "x " * 250, "Aa Bb", "money $ " * 40, " ".join(f"w{i}" for i in range(220)), "LOUD " * 201,
             "\t a\nb\x0b c  ", "é ü " * 120, " ".join(f"Word{i}#" for i in range(400)), "q" * 50_000]
    texts += [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 300))) for _ in range(20)]
    docs = [(i if r.random() > .1 else None, "clash", r.choice(texts), r.choice(["en", "en", "de", "", None]), 7) for i in range(n)]
    docs += docs[:9]  # repeated rows
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None]), "x") for i in range(0, n, 2)] + [(4, 1, 1, "x"), (None, 1, 1, "x")]
    return docs, labels


def spark_rows(spark, docs, labels, **kw):
    return Counter(tuple(r) for r in I.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), **kw)
                   .select(COLUMNS).collect())


def brute(docs, labels):
    good = {d for d, q, _, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t, _ in labels if d is not None and t == 1}
    least = {}
    for d, _, t, _, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, _, t, lang, _ in docs:
        t = t or ""
        words = [w for w in __import__("re").split("[ \t-\r]+", t) if w]
        caps = sum("A" <= c <= "Z" for c in t)
        fail = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * caps > 3 * len(t),
                "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        rows.append((lang or "", {k for k, v in fail.items() if v}, d in good, d in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            kept = own
            for step, f in enumerate(order, 1):
                gone = [r for r in kept if f in r[1]]
                before = [r for r in own if r[1] & set(order[:step - 1])]
                kept = [r for r in kept if f not in r[1]]
                shapley[f] += len(gone)
                out.append([part, "".join(order), step, len(kept), len(gone), sum(f in r[1] for r in before),
                            sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        for row in out:
            if row[0] == part:
                row[-1] = shapley[row[-1]] if isinstance(row[-1], str) else row[-1]
    return Counter(tuple(r) for r in out)


def test_equals_brute_force_and_sql(spark):
    for seed in (1, 2):
        docs, labels = corpus(seed)
        got = spark_rows(spark, docs, labels)
        assert got == brute(docs, labels)
        con = duckdb.connect()
        con.register("f", pd.DataFrame(docs, columns=["doc_id", "x", "text", "lang", "mask"]).astype({"doc_id": "Int64"}))
        con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, lang FROM f")
        con.register("g", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic", "x"]).astype(
            {"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
        con.execute("CREATE VIEW labels AS SELECT * FROM g")
        assert got == Counter(tuple(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.FILTER_AUDIT})").fetchall())


def test_empty_tables_and_other_filters(spark):
    docs, labels = corpus(3)
    assert not spark_rows(spark, [], labels)
    assert spark_rows(spark, docs, []) == brute(docs, [])
    two = (I.Filter("x", lambda text, words, kinds: words < 3), I.Filter("y", lambda text, words, kinds: text.rlike("a")))
    got = spark_rows(spark, docs, labels, filters=two)
    assert {r[1] for r in got} == {"xy", "yx"}
    for part in {r[0] for r in got}:  # what two filters leave does not depend on their order
        assert len({r[3] for r in got if r[0] == part and r[2] == 2}) == 1


def test_recursion_does_not_grow_with_the_documents(spark):
    docs, labels = corpus(4)
    few = I.cells(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    many = I.cells(spark.createDataFrame(docs * 5, DOCS), spark.createDataFrame(labels, LABELS))
    assert few.count() == many.count() and few.agg({"n": "sum"}).first()[0] * 5 == many.agg({"n": "sum"}).first()[0]
