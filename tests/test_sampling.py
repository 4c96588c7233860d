import math

import pytest
from pyspark.sql import functions as F

from kairos.functions.hashing import hash_key
from kairos.operators import cohorts, sampling


def groups(spark, sizes):
    rows = [(g, i) for g, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "g int, i int")


@pytest.mark.parametrize("rounding,f", [("floor", 0.2), ("ceil", 0.1), ("floor", 0.01)])
def test_exact_fraction(spark, rounding, f):
    sizes = [0, 1, 4, 5, 9, 10, 11, 99, 5003]
    df = groups(spark, sizes)
    got = dict(sampling.sample_fraction(df, ["g"], 3, ["i"], f, rounding).groupBy("g").count().collect())
    rnd = math.floor if rounding == "floor" else math.ceil
    for g, n in enumerate(sizes):
        want = rnd(round(n * f, 9))
        assert got.get(g, 0) == want


def test_first_k_matches_sort(spark):
    df = groups(spark, [3, 50, 6000]).withColumn("h", hash_key(9, "g", "i"))
    got = {(r.g, r.i, r.rank) for r in sampling.first_k_per_group(df, ["g"], "h", 20, rank_col="rank").collect()}
    want = set()
    for g, rows in enumerate([3, 50, 6000]):
        pdf = [(r.h, r.i) for r in df.where(F.col("g") == g).collect()]
        for rank, (_, i) in enumerate(sorted(pdf), 1):
            if rank <= 20:
                want.add((g, i, rank))
    assert got == want


def test_hot_group_is_exact(spark):
    # one group holds most rows: the result is still exactly k rows, the k smallest hashes
    df = groups(spark, [20000, 3]).withColumn("h", hash_key(1, "g", "i"))
    out = sampling.first_k_per_group(df, ["g"], "h", 100).where("g = 0")
    hs = sorted(r.h for r in out.collect())
    allh = sorted(r.h for r in df.where("g = 0").collect())
    assert hs == allh[:100]


def test_train_test_split_disjoint(spark):
    df = groups(spark, [10, 31])
    train, test = sampling.train_test_split(df, "g", 1234, ["i"], 0.1)
    t = dict(test.groupBy("g").count().collect())
    assert t == {0: 1, 1: 4}
    assert train.join(test, ["g", "i"]).count() == 0
    assert train.count() + test.count() == 41


def test_cohort_shares_follow_weights(spark):
    rows = [(str(i), "A", "B", "C") for i in range(4000)]
    t = spark.createDataFrame(rows, "customerID string, customerType string, riskLevel string, investmentCapacity string")
    iid = cohorts.with_client(t, ["customerType", "riskLevel", "investmentCapacity"], iid=True)
    counts = dict(iid.groupBy("client_id").count().collect())
    assert set(counts) == set(range(20))
    assert all(abs(c - 200) < 70 for c in counts.values())
    skew = cohorts.with_client(t, ["customerType", "riskLevel", "investmentCapacity"])
    assert skew.select("client_id").distinct().count() > 1
    # deterministic in (seed, key)
    assert {r.customerID: r.client_id for r in skew.collect()} == {
        r.customerID: r.client_id for r in cohorts.with_client(t, ["customerType", "riskLevel", "investmentCapacity"]).collect()}


def test_combinations_meet_customers_by_one_number(spark):
    # tables keyed by text take whole memory pages on the driver, however few combinations there are
    names = ["customerType", "riskLevel", "investmentCapacity"]
    rows = [(str(i), "AB"[i % 2], None if i % 3 else "x", "y") for i in range(60)] + [("z", None, None, None)]
    t = spark.createDataFrame(rows, "customerID string, customerType string, riskLevel string, investmentCapacity string")
    got = cohorts.with_client(t, names)
    plan = got._jdf.queryExecution().executedPlan().toString()  # before it runs: afterwards it is shown twice
    assert sorted(r.customerID for r in got.collect()) == sorted(r[0] for r in rows)
    assert plan.count("Join") == 1 and "Join [_k#" in plan


def test_profitable_assets_are_not_broadcast(spark):
    import datetime as dt
    from kairos.functions.dates import CutoffGrid
    from kairos.plans import datasets as D
    from kairos.schemas import TRANSACTIONS
    seen, real = [], D.build_once
    D.build_once = lambda df, name: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name)
    try:
        tx = spark.createDataFrame([("t", "c", "A", "Buy", 1.0, dt.datetime(2000, 2, 1))], TRANSACTIONS)
        prices = spark.createDataFrame([("A", dt.datetime(2000, 1, 1), 1.0), ("A", dt.datetime(2000, 3, 1), 2.0)],
                                       "ISIN string, timestamp timestamp_ntz, closePrice double")
        lab = D.test_labels(tx, prices, CutoffGrid(dt.date(2000, 1, 10), dt.date(2000, 1, 10), 14))
        assert [tuple(r) for r in lab.good.collect()] == [("c@2000-01-10", "A")]
    finally:
        D.build_once = real
    assert "Broadcast" not in dict(seen)["good"]


def test_histogram_is_dense(spark):
    rows = [("1", "A", "x", "y", 0), ("2", "B", "x", "y", 3)]
    a = spark.createDataFrame(rows, "customerID string, customerType string, riskLevel string, investmentCapacity string, client_id int")
    h = cohorts.trait_histogram(a)
    assert h.count() == 20 * 4
    assert h.where("n_customers > 0").count() == 6
    s = cohorts.client_sizes(a)
    assert s.count() == 20 and s.where("n_customers = 0").count() == 18


def orders(spark, n, keys):
    """key -> its order of 0 .. n-1."""
    x = spark.range(keys).select(F.col("id").cast("string").alias("key"), F.lit(n).cast("bigint").alias("n"))
    x = x.withColumn("keys", sampling.order_keys("t", "key")).withColumn("s", sampling.order_shape(F.col("n"))).select("key", "n", "keys", "s.*")
    x = x.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("a") * F.col("b") - 1)))
    x = sampling.drawn_positions(x, "j", "keys", "a", "b").where("pos < n")
    got = x.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "pos"))), lambda s: s["pos"]).alias("o"))
    return [r["o"] for r in got.collect()]


@pytest.mark.parametrize("n", [1, 2, 9, 64, 65, 1000])
def test_orders_are_permutations(spark, n):
    assert all(sorted(o) == list(range(n)) for o in orders(spark, n, 20))


def test_small_orders_are_equally_likely(spark):
    from collections import Counter
    seen = Counter(map(tuple, orders(spark, 4, 6000)))
    assert len(seen) == 24
    assert sum((c - 250) ** 2 / 250 for c in seen.values()) < 50  # 23 degrees of freedom


def test_triples_and_gaps_of_entries_are_uniform(spark):
    n, cells = 60, [0] * 64
    got = orders(spark, n, 3000)
    for o in got:
        a, b, c = (x * 4 // n for x in o[:3])
        cells[16 * a + 4 * b + c] += 1
    # triples of distinct places, by the quarters they fall into: k of the 15 places of a quarter are taken
    free = lambda *q: math.prod(15 - q[:i].count(q[i]) for i in range(3))
    want = [3000 * free(a, b, c) / (60 * 59 * 58) for a in range(4) for b in range(4) for c in range(4)]
    assert sum((x - y) ** 2 / y for x, y in zip(cells, want)) < 105  # 63 degrees of freedom
    gaps = [0] * 59
    for o in got:
        gaps[(o[1] - o[0]) % n - 1] += 1
        gaps[(o[9] - o[8]) % n - 1] += 1
    assert sum((x - 6000 / 59) ** 2 / (6000 / 59) for x in gaps) < 98  # 58 degrees of freedom


def test_seeded_shuffle_numbers_the_rows(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    rows = sampling.seeded_shuffle(df, 3, "id", "place").collect()
    assert [r["place"] for r in rows] == list(range(500))
    assert [r["id"] for r in rows] == [r["id"] for r in sampling.seeded_shuffle(df, 3, "id").collect()]
    assert sampling.seeded_shuffle(df.limit(0), 3, "id", "place").count() == 0


def test_split_of_exploded_rows_joins_one_row_per_group(spark, tmp_path):
    # an explode hides how many rows there are: the rows must never be the side that is broadcast
    spark.range(300).withColumn("g", (F.col("id") % 3).cast("int")).write.parquet(str(tmp_path / "few"))
    many = spark.read.parquet(str(tmp_path / "few")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(40))))
    drawn = sampling.sample_fraction(many, ["g"], 7, ["id", "i"], 0.2)
    train, test = sampling.train_test_split(many, "g", 7, ["id", "i"], 0.1)
    assert dict(drawn.groupBy("g").count().collect()) == {0: 800, 1: 800, 2: 800}
    assert dict(test.groupBy("g").count().collect()) == {0: 400, 1: 400, 2: 400}
    assert train.count() == 10800 and train.intersect(test).count() == 0
    for df in (drawn, train, test):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan.split("Initial Plan")[0]


def test_split_keeps_every_row(spark):
    # equal rows, and rows of no group
    df = spark.createDataFrame([(1, 5)] * 12 + [(None, 1), (None, 2)], "g int, i int")
    train, test = sampling.train_test_split(df, "g", 1234, ["i"], 0.1)
    assert sorted(map(tuple, test.collect())) == [(1, 5)] * 2
    assert sorted(map(tuple, train.collect()), key=str) == sorted([(1, 5)] * 10 + [(None, 1), (None, 2)], key=str)


def test_bad_assets_meet_the_good_ones_as_a_list_in_the_shuffle_that_ranks_them(spark):
    from kairos.plans import datasets as D
    good = spark.createDataFrame([("e1", "A1"), ("e1", None), ("e2", "A1"), ("e2", "A2"), ("e2", "A3"), ("e3", "Z")], "example_id string, ISIN string")
    assets = spark.createDataFrame([("A1",), ("A2",), ("A3",), ("A4",), (None,)], "ISIN string")
    bad = D.bad_assets(D.Labels(None, None, good, None), assets, 3)
    got = {}
    for r in bad.collect():
        got.setdefault(r["example_id"], []).append(r["ISIN"])
    assert set(got["e2"]) == {"A4", None} and len(got["e1"]) == len(got["e3"]) == 3 and "A1" not in got["e1"]
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "array_contains" in plan
