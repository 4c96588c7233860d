import json
import os
import tempfile

import pytest
from pyspark.sql import types as T

from kairos.sources import readers, writers

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def tmpdir():
    return tempfile.mkdtemp(prefix="kairos-test-")


def test_jsonl_tolerant_and_strict(spark):
    d = tmpdir()
    p = os.path.join(d, "x.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"a": 1, "b": "x"}) + "\n{broken\n" + json.dumps({"a": 2, "b": "y"}) + "\n")
    good, bad = readers.read_jsonl_tolerant(spark, p, SCHEMA)
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, p, SCHEMA).collect()


def test_scores_csv_pipe_quote(spark):
    d = tmpdir()
    p = os.path.join(d, "s.csv")
    with open(p, "w") as f:
        f.write("label,pre_to_fine_score,text\n1,0.5,|a, b|\n0,,|c|\n0,0.25,|d|\n")
    df = readers.read_scores_csv(spark, p)
    assert df.count() == 2 and {r.text for r in df.collect()} == {"a, b", "d"}


def test_csv_domain_readers(spark):
    d = tmpdir()
    p = os.path.join(d, "ci.csv")
    with open(p, "w") as f:
        f.write("customerID,customerType,riskLevel,investmentCapacity\nc1,Predicted_A,x,y\nc1,B,x,y\n")
    df = readers.read_customers(spark, p)
    assert df.columns == ["customerID", "customerType", "riskLevel", "investmentCapacity", "_ingest_seq"]


def test_write_partitioned_and_reload(spark):
    d = tmpdir()
    df = spark.createDataFrame([(0, "e1", True), (1, "e2", False), (1, "e3", True)],
                               "client_id int, example_id string, label boolean")
    writers.write_examples(df, os.path.join(d, "ex"), "by_client")
    back = spark.read.json(os.path.join(d, "ex"))
    assert back.where("client_id = 1").count() == 2     # partition pruning on the layout column
    calls = []

    def build():
        calls.append(1)
        return df
    a = writers.materialize_or_load(spark, os.path.join(d, "m"), build)
    b = writers.materialize_or_load(spark, os.path.join(d, "m"), build)
    assert a.count() == b.count() == 3 and len(calls) == 1


def test_subsets_union(spark):
    d = tmpdir()
    for name in ["s1", "s2"]:
        spark.createDataFrame([(1, name)], "a long, b string").write.parquet(os.path.join(d, name))
    u = readers.read_subsets(spark, {n: os.path.join(d, n) for n in ["s1", "s2"]})
    assert sorted((r.subset, r.b) for r in u.collect()) == [("s1", "s1"), ("s2", "s2")]


def test_flatten_and_format(spark):
    from kairos.operators import cleaning
    df = spark.createDataFrame([((1, (2, 3)), "i", "o", "x")],
                               "s struct<a:int,b:struct<c:int,d:int>>, input string, output string, instruction string")
    f = cleaning.flatten(df.select("s"))
    assert f.columns == ["s.a", "s.b.c", "s.b.d"]
    g = cleaning.format_instruction_dataset(df.drop("s"))
    assert g.columns == ["instruction", "response"] and g.collect()[0].instruction == "i"


def test_keep_first_needs_a_load_order(spark):
    from kairos.operators import cleaning
    d = tmpdir()
    head = "customerID,customerType,riskLevel,investmentCapacity,seq\n"
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write(head + "c1,first,x,y,1\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write(head + "".join(f"z{i},pad,x,y,{i + 10}\n" for i in range(500)) + "c1,second,x,y,2\n")
    with pytest.raises(ValueError):
        readers.read_customers(spark, d)
    df = readers.read_customers(spark, d, order_column="seq")
    kept = cleaning.keep_first(df, "customerID")
    assert kept.where("customerID = 'c1'").first()["customerType"] == "first"


def test_shuffled_jsonl_is_the_same_for_any_split(spark):
    d = tmpdir()
    p = os.path.join(d, "x.jsonl")
    with open(p, "w") as f:
        f.writelines(json.dumps({"a": i, "b": "x" * 50}) + "\n" for i in range(400))
    orders = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        orders.append([r.a for r in readers.read_jsonl_shuffled(spark, p, SCHEMA, seed=3).collect()])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert orders[0] == orders[1] != sorted(orders[0])


CHAT = "prompt array<struct<role:string,content:string>>, completion array<struct<role:string,content:string>>, n long"


def chat(i):
    tricky = ['plain', '"prompt": {"x"}], "2020": [{', 'a \\" }, { \\\\', 'line\nbreak ]}', "é漢😀", ""]
    return {"prompt": [{"role": "user", "content": tricky[i % len(tricky)] + "x" * (i % 7 * 40)}, {"role": "user", "content": str(i)}],
            "completion": [{"role": "assistant", "content": tricky[(i + 1) % len(tricky)]}] * (i % 3), "n": i}


def flat(key, e):
    turns = lambda t: tuple((x["role"], x["content"]) for x in t)
    return key, turns(e["prompt"]), turns(e["completion"]), e["n"]


def test_one_large_json_object_is_read_by_many_tasks(spark):
    data = {"none": [], "2019-01-01": [chat(i) for i in range(90)], "hollow": [], "2019-02-01": [chat(90)], "two": [],
            'k"ey \\ é': [chat(i) for i in range(91, 200)], "end": []}
    want = sorted(flat(k, e) for k, v in data.items() for e in v)
    for indent in (None, 4):
        p = os.path.join(tmpdir(), "x.json")
        with open(p, "w") as f:
            json.dump(data, f, indent=indent)
        for size in ("1500", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            try:
                df = readers.read_keyed_json(spark, p, CHAT, "prompt", "cutoff")
                assert sorted(flat(r["cutoff"], r) for r in df.collect()) == want
                parts = spark.read.option("lineSep", '"prompt":').text(p).rdd.getNumPartitions()
                assert parts > 10 if size == "1500" else parts <= 8  # one a core
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")


def test_keyed_json_without_elements_or_broken(spark):
    d = tmpdir()
    for name, text in (("a", "{}"), ("b", '{"x": [], "y": []}'), ("c", ""), ("d", ' {\n"x": [ ] }\n')):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    assert readers.read_keyed_json(spark, d, CHAT, "prompt", "cutoff").count() == 0
    with open(os.path.join(d, "e"), "w") as f:
        f.write('{"x": [{"prompt": [}]}')
    with pytest.raises(Exception):
        readers.read_keyed_json(spark, d, CHAT, "prompt", "cutoff").collect()


def test_keyed_json_round_trip(spark):
    rows = [flat(("2019-01-01" if i % 3 else None) if i % 5 else 'k"', chat(i)) for i in range(60)] + [flat("twice", chat(7))] * 2
    df = spark.createDataFrame(rows, f"cutoff string, {CHAT}")
    p = os.path.join(tmpdir(), "out")
    writers.write_keyed_json(df, p, "cutoff", "n", 4)
    files = [os.path.join(r, f) for r, _, fs in os.walk(p) for f in fs if f.endswith(".txt")]
    assert 1 < len(files) <= 4
    loaded = [flat(k, e) for f in files for k, v in json.load(open(f)).items() for e in v]  # each is one JSON object
    want = sorted(("null" if r[0] is None else r[0], *r[1:]) for r in rows)
    assert sorted(loaded) == want
    back = readers.read_keyed_json(spark, p, CHAT, "prompt", "cutoff")
    assert sorted(flat(r["cutoff"], r) for r in back.collect()) == want
    writers.write_keyed_json(df.limit(0), p, "cutoff", "n", 4)
    assert not [f for _, _, fs in os.walk(p) for f in fs if f.endswith(".txt") and os.path.getsize(os.path.join(_, f))]
