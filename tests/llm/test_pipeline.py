import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from kairos.llm import bpe, mixing, simhash, toxicity
from kairos.llm.queries import word_bpe_spec

pytest.importorskip("public_tokenizers")


def write(spark, path):
    r = random.Random(4)
    calm = ["river", "stone", "walk", "green", "table", "paper", "light", "seven", "morning", "window"]
    docs, labels = [], []
    for i in range(260):
        toxic = int(r.random() < 0.2)
        words = [r.choice(calm) + r.choice(["", "er", "ing", "s", "ful"]) for _ in range(r.randint(6, 40))]
        if toxic:
            words += ["idiot", "moron", "you", "scum"] * 2
        if i % 9 == 0:
            words += ["mail", f"a{i}@b.co"]
        docs.append((i, " ".join(words), r.choice(["en", "de"]), r.choice(["src0", "src1", "src12"]), None))
        labels.append((i, 1, toxic))
    docs += [(300 + i, docs[i][1].upper(), "en", "src0", 0) for i in range(30)] + [docs[4], (400, None, None, None, None), (401, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, {i: y for i, _, y in labels}


def test_stages_equal_brute_force(spark, tmp_path):
    docs, truth = write(spark, tmp_path)
    raw = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = P.drop_toxic(spark, raw, str(tmp_path))
    model = toxicity.score(raw, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    bad = {r["doc_id"] for r in model if r["predicted"]}
    assert sum((i in bad) == bool(y) for i, y in truth.items()) / len(truth) > 0.97
    left = [d for d in docs if d[0] not in bad]
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d[0] for d in left)

    # one of each group, by all pairs
    fps = [simhash.fingerprint(d[1]) for d in left]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for d, g in zip(left, group):
        least[g] = min(least.get(g, d[0]), d[0])
    want = {d[0]: d for d, g in zip(left, group) if least[g] == d[0]}
    one = [r.asDict() for r in P.drop_near_copies(spark, clean, "").collect()]
    assert Counter(r["doc_id"] for r in one) == Counter(list(want))

    # redaction and mixing by the plan, then ids of the automaton
    redacted = {i: re.sub(r"a\d+@b\.co", "[EMAIL]", d[1]) if d[1] else d[1] for i, d in want.items()}
    rows = [(i, redacted[i], *want[i][2:]) for i in want]
    plan = mixing.plan(spark.createDataFrame(rows, raw.schema)).collect()
    tok = bpe.tokenizer(word_bpe_spec())
    ids = lambda t: [int(x) for g in tok.encode(t or "") for x in g[1].split()]
    expected = Counter()
    for r in plan:
        expected[(r["doc_id"], tuple(ids(redacted[r["doc_id"]])))] += r["copies"]
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in P.run(spark, str(tmp_path)).collect())
    assert got == +expected and got


def test_stages_keep_the_columns(spark, tmp_path):
    write(spark, tmp_path)
    raw = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 AS Text", "'x' AS holes", "2 AS epochs", "3 AS c0")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, raw, str(tmp_path))
        assert out.columns == raw.columns and [f.dataType for f in out.schema] == [f.dataType for f in raw.schema], name
        assert out.count() > 0
        assert stage(spark, raw.limit(0), str(tmp_path)).count() == 0
