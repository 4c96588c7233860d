import pytest
from pyspark.sql import functions as F

from kairos.operators import federated, qa


def parse(spark, pairs):
    df = spark.createDataFrame(pairs, "output string, gold string")
    out = qa.score_generations(df.withColumn("prompt", F.lit("p")))
    return [(r.correct, r.pred, r.gold_parsed) for r in out.collect()]


@pytest.mark.parametrize("output,gold,want", [
    ("Yes", "yes", (1, "yes", "yes")),
    ("blah\n## No\nmore", "yes", (0, "no", "yes")),
    ("yesyes", "yes", (1, "yes", "yes")),
    ("nono", "yes", (0, "no", "yes")),
    ("yes!!", "no", (0, "yes", "no")),
    ("unclear", "unclear", (2, "unclear", "unclear")),
    ("yes", "because.\nThe answer is: yes ###", (1, "yes", "yes")),
    ("yes", "no marker ###", (2, "yes", "no marker ###")),
    ("yés", "yes", (2, "yés", "yes")),
])
def test_answer_parser(spark, output, gold, want):
    assert parse(spark, [(output, gold)])[0] == want


def test_accuracy_counts_unparsable_equal_raw(spark):
    df = spark.createDataFrame([("unclear", "unclear"), ("yes", "yes"), ("no", "yes")], "output string, gold string")
    s = qa.accuracy_summary(qa.score_generations(df)).collect()[0]
    assert (s.correct, s.counted, s.unable_to_find_answer, s.total) == (1, 2, 1, 3)
    assert abs(s.accuracy - 2 / 3) < 1e-12


def test_prompt_builders(spark):
    df = spark.createDataFrame([(["c1", "c2"], "q?")], "CONTEXTS array<string>, QUESTION string")
    r = df.select(qa.add_instruction(qa.qa_prompt(F.col("CONTEXTS"), F.col("QUESTION"))).alias("p"),
                  qa.chat_wrap(F.lit("x")).alias("w")).collect()[0]
    assert r.p == qa.SYSTEM + "\nc1\nc2\nq?\n" + qa.USER + "\n"
    assert r.w == "<|im_start|>question\nx<|im_end|>\n<|im_start|>answer\n"


def test_generations_reach_every_equal_prompt(spark):
    rows = spark.createDataFrame([("p1", "yes"), ("p1", "no"), ("p2", "no")], "prompt string, gold string")
    gens = spark.createDataFrame([("p1", "yes")], "prompt string, output string")
    got = qa.attach_generations(rows, gens).where("output = 'yes'").count()
    assert got == 2


def test_class_weights_edges(spark):
    df = spark.createDataFrame([(0, True), (0, True), (1, False), (2, True), (2, False)], "client_id int, label boolean")
    w = {r.client_id: (r.desirable_weight, r.undesirable_weight) for r in federated.class_weights(df).collect()}
    assert w[0] == (1.0, None)          # all true: U = 0
    assert w[1] == (None, 1.0)          # all false: D = 0
    assert w[2] == (4 / 3, 1.0)


def test_weighted_vectors(spark):
    df = spark.createDataFrame([(1, "w", 1, [1.0, 2.0]), (1, "w", 3, [3.0, 6.0])],
                               "round int, param string, num_examples long, values array<double>")
    assert [r["value"] for r in federated.weighted_vectors_long(df).orderBy("pos").collect()] == [2.5, 5.0]


def test_a_prompt_generated_twice_does_not_multiply_rows(spark):
    rows = spark.createDataFrame([("p", 1), ("q", 2)], "prompt string, i int")
    gen = spark.createDataFrame([("p", "b"), ("p", "a")], "prompt string, output string")
    assert sorted((r.i, r.output) for r in qa.attach_generations(rows, gen).collect()) == [(1, "a"), (2, None)]
