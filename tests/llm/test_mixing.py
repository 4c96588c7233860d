import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from kairos.llm import mixing as M
from kairos.llm import oracles

SCHEMA = "doc_id long, text string, lang string, source string, share string"


def corpus(seed, n=160):
    r = random.Random(seed)
    return [(i if r.random() > .03 else None, r.choice([None, "", *["w " * r.randint(1, 60)] * 12]),
             r.choice(["en", "en", "de", "fr", "xx", None]), r.choice(["src0"] * 4 + ["src1", "src2", "src11", "blog", None]), "x")
            for i in range(n)]


def plan_rows(spark, rows, t):
    out = M.plan(spark.createDataFrame(rows, SCHEMA), t).collect()
    return Counter((r["doc_id"], r["domain"], r["language"], r["source"], r["n_tokens"], r["copies"]) for r in out)


@pytest.mark.parametrize("seed,percent,epochs", [(1, 60, 4), (2, 20, 1), (3, 350, 4), (4, 900, 4)])
def test_plan_equals_sql(spark, seed, percent, epochs):
    t = M.Targets(percent=percent, max_epochs=epochs)
    rows = corpus(seed)
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "share"]).astype({"doc_id": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source FROM frame")
    want = Counter(tuple(r) for r in con.execute(oracles._mixing(t)).fetchall())
    assert plan_rows(spark, rows, t) == want


def test_shortage_goes_to_siblings_before_ancestors(spark):
    t = M.Targets(domains=(("a", 1, "^a"), ("b", 1, "")), languages={}, percent=50, max_epochs=1)
    # domain a: a1 is tiny, a2 is large; domain b is large
    rows = [(1, "w " * 10, "en", "a1", "")] + [(i, "w", "en", "a2", "") for i in range(2, 992)] + [
        (i, "w", "en", "b1", "") for i in range(992, 1992)]
    got = Counter()
    for (_, _, _, source, n, copies), k in plan_rows(spark, rows, t).items():
        got[source] += n * copies * k
    assert got == {"a1": 10, "a2": 490, "b1": 500}


def test_mix_repeats_rows_as_planned_and_keeps_columns(spark):
    t = M.Targets(percent=220, max_epochs=3)
    rows = corpus(7)
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.mix(df, t)
    assert out.columns == df.columns
    want = Counter()
    for (doc, _, language, source, _, copies), k in plan_rows(spark, rows, t).items():
        want[(doc, language, source)] += copies * k
    got = Counter((r["doc_id"], r["lang"] or "", r["source"] or "") for r in out.collect())
    assert got == +want
    assert M.mix(df.limit(0), t).count() == 0
