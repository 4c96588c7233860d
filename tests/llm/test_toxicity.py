import random
import zlib

import pytest

from kairos.llm import toxicity as X


def corpus(n, seed=1):
    r = random.Random(seed)
    calm = ["river", "stone", "walk", "green", "table", "paper", "light", "seven", "morning", "window"]
    docs, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.2)
        words = [r.choice(calm) + r.choice(["", "er", "ing"]) for _ in range(r.randint(3, 60))]
        if toxic:
            for _ in range(max(2, len(words) // 10)):
                words.insert(r.randint(0, len(words)), r.choice(["idiot", "zorblak" + r.choice("aeiou"), "you moron"]))
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, toxic))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, tox_score string"


def test_learns_from_the_rest_and_ranks_the_held_out(spark):
    docs, labels = corpus(500)
    truth = {i: y for i, _, y in labels}
    # wrong labels on held-out rows must not matter
    lies = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    out = X.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(lies, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_defined_cases(spark):
    docs = [(1, None, "a", "x"), (1, None, "a", "x"), (None, "you idiot", "a", "y"), (2, "", "b", "z"), (3, "w " * 50_000, "c", "q")]
    df = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r["score"] for r in X.score(df, none).collect()) == [0.0] * 5
    assert X.reject(df, none).count() == 5 and X.reject(df, none).columns == df.columns
    one = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (None, 0, 0), (2, 0, None)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in X.score(df, one).collect()} <= {0.0, 1.0}
    assert X.score(df.limit(0), none).count() == 0


def test_reject_drops_the_toxic_rows_only(spark):
    docs, labels = corpus(400, 3)
    df = spark.createDataFrame(docs, SCHEMA)
    kept = {r["doc_id"] for r in X.reject(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    truth = {i: y for i, _, y in labels}
    assert sum((i not in kept) == bool(y) for i, y in truth.items()) / len(truth) > 0.97


@pytest.mark.parametrize("text,name", [("you idiot", "near_second_person"), ("AAA BBB", "shouting"), ("wow!!", "loud_marks"),
                                       ("1d10t id10t", "hidden_insults"), ("sooooo", "stretched"), ("abcdefg", "beginnings")])
def test_features_answer_their_signs(text, name):
    at = X.FEATURES.index(name)
    entry = frozenset({"abcde"})
    assert X.features(text, frozenset(), entry)[at] > 0 == X.features("plain words", frozenset(), entry)[at]
