from pyspark.sql import functions as F

from kairos.operators import federated
from kairos.session import build_once, fingerprint


def test_build_once_knows_its_inputs(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "tables")
    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(src)
    query = lambda k=1: spark.read.parquet(src).select("id", F.transform(F.array("v"), lambda x: x + k).alias("v"))
    first = build_once(query(), "t", root)
    assert fingerprint(query()) == fingerprint(query()) != fingerprint(query(2))
    assert build_once(query(), "t", root).inputFiles() == first.inputFiles()
    assert not set(build_once(query(2), "t", root).inputFiles()) & set(first.inputFiles())
    spark.range(10, 12).withColumn("v", F.col("id") * 2).write.mode("append").parquet(src)
    again = build_once(query(), "t", root)
    assert (first.count(), again.count()) == (10, 12)


def test_what_a_plan_does_not_tell_is_built_each_time(spark):
    local = spark.createDataFrame([(1,)], "x int")
    assert fingerprint(local) is None and fingerprint(spark.range(3).select(F.rand(1).alias("r"))) is None
    assert build_once(local, "t").inputFiles() != build_once(local, "t").inputFiles()


def test_vector_means_by_chunks(spark):
    rows = [(1, "w", 2, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, "w", 6, [5.0, 2.0, 1.0]), (1, "b", 1, [7.0]), (2, "w", 3, []), (2, "w", 1, [1.5])]
    df = spark.createDataFrame(rows, "round int, param string, num_examples long, values array<double>")
    want = [(1, "b", 0, 7.0), (1, "w", 0, 4.0), (1, "w", 1, 2.0), (1, "w", 2, 1.5), (1, "w", 3, 4.0), (1, "w", 4, 5.0), (2, "w", 0, 1.5)]
    for chunk in (2, 32):
        assert sorted(map(tuple, federated.weighted_vectors_long(df, chunk).collect())) == want
    assert federated.weighted_vectors(df, 2).count() == 5
