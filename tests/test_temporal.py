import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairos import schemas
from kairos.functions.dates import CutoffGrid
from kairos.operators import cleaning, temporal

D = dt.datetime


def tx_frame(spark, rows):
    return spark.createDataFrame(rows, schemas.TRANSACTIONS)


def test_cutoff_grid_counts():
    g = CutoffGrid(dt.date(2021, 6, 4), dt.date(2019, 8, 1), 28)
    assert g.count == 25 and g.dates()[-1] == dt.date(2019, 8, 2)
    t = CutoffGrid(dt.date(2022, 6, 2), dt.date(2021, 12, 1), 14)
    assert t.count == 14


def test_horizon_edges(spark):
    grid = CutoffGrid(dt.date(2000, 1, 1), dt.date(2000, 1, 1), 14)
    c = D(2000, 1, 1)
    rows = [("t0", "c1", "A", "Buy", 1.0, c),
            ("t1", "c1", "B", "Buy", 1.0, c + dt.timedelta(days=1)),
            ("t2", "c1", "C", "Buy", 1.0, c + dt.timedelta(days=180)),
            ("t3", "c1", "D", "Buy", 1.0, c + dt.timedelta(days=181)),
            ("t4", "c1", "E", "Sell", 1.0, c + dt.timedelta(days=5))]
    got = {r.ISIN for r in temporal.horizon_purchases(tx_frame(spark, rows), grid).collect()}
    assert got == {"B", "C"}


def test_horizon_matches_range_join(spark):
    rng = np.random.default_rng(1)
    grid = CutoffGrid(dt.date(2000, 6, 1), dt.date(1999, 1, 1), 14)
    rows = [(f"t{i}", f"c{rng.integers(5)}", f"I{rng.integers(7)}", "Buy", 1.0,
             D(1998, 6, 1) + dt.timedelta(days=int(rng.integers(900)))) for i in range(400)]
    tx = tx_frame(spark, rows)
    got = {(r.k, r.customerID, r.ISIN) for r in temporal.horizon_purchases(tx, grid).collect()}
    want = set()
    for k, cut in enumerate(grid.dates()):
        c = D.combine(cut, dt.time())
        for _, cu, isin, _, _, ts in rows:
            if c < ts <= c + dt.timedelta(days=180):
                want.add((k, cu, isin))
    assert got == want


def test_asof_prices(spark):
    grid = CutoffGrid(dt.date(2000, 3, 1), dt.date(2000, 3, 1), 14)
    rows = [("AT", D(2000, 3, 1), 10.0), ("AT", D(2000, 3, 5), 12.0),       # price exactly at cutoff
            ("NB", D(2000, 3, 2), 5.0),                                      # none before
            ("NA", D(1999, 1, 1), 5.0),                                      # none after
            ("NL", D(2000, 2, 1), 7.0), ("NL", D(2000, 4, 1), 9.0), ("NL", D(2000, 4, 2), None)]
    p = spark.createDataFrame(rows, schemas.CLOSE_PRICES)
    m = {r.ISIN: (r.start_price, r.end_price) for r in temporal.price_moves(p, grid).collect()}
    assert m == {"AT": (10.0, 12.0), "NL": (7.0, 9.0)}
    prof = {r.ISIN for r in temporal.profitable_assets(p, grid).collect()}
    assert prof == {"AT", "NL"}


def _pandas_bins(df):
    out = []
    for isin, g in df.groupby("ISIN"):
        s = g.set_index("timestamp").sort_index()["closePrice"].resample("10W").agg(
            ["last", "mean", "max", "min"]).dropna()
        for end, r in s.iterrows():
            out.append((isin, end.date(), r["last"], round(r["mean"], 9), r["max"], r["min"]))
    return sorted(out)


def test_ten_week_matches_pandas(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(40):
        start = D(1999, 1, 1) + dt.timedelta(days=int(rng.integers(30)))
        days = sorted(set(int(x) for x in rng.integers(0, 500, size=int(rng.integers(1, 60)))))
        for d in days:
            rows.append((f"S{s}", start + dt.timedelta(days=d), float(rng.integers(1, 1000)) / 4))
    rows.append(("GAP", D(2000, 1, 5), 1.0))          # Wednesday start
    rows.append(("GAP", D(2000, 8, 2), 2.0))          # after a 30-week gap
    rows.append(("SUN", D(2000, 1, 2), 3.0))          # Sunday start
    pdf = pd.DataFrame(rows, columns=["ISIN", "timestamp", "closePrice"])
    got = temporal.ten_week_summary(spark.createDataFrame(rows, schemas.CLOSE_PRICES)).collect()
    got = sorted((r.ISIN, r.period_end, r.end_price, round(r.avg_price, 9), r.high_price, r.low_price) for r in got)
    assert got == _pandas_bins(pdf)
    ends = {r[1] for r in got if r[0] == "GAP"}
    assert min(ends) == dt.date(2000, 1, 9)
    assert {r[1] for r in got if r[0] == "SUN"} == {dt.date(2000, 1, 2)}


def test_keep_first_then_strip(spark):
    rows = [("c1", "Predicted_A", "x", "y", 2), ("c1", "B", "x", "y", 5), ("c2", "C", "Predicted_Z", None, 1),
            ("c2", "D", "q", "q", 0)]
    df = spark.createDataFrame(rows, schemas.CUSTOMER_INFORMATION)
    out = cleaning.strip_token(cleaning.keep_first(df, "customerID").drop("_ingest_seq"), schemas.TRAIT_COLUMNS)
    got = {r.customerID: (r.customerType, r.riskLevel, r.investmentCapacity) for r in out.collect()}
    assert got == {"c1": ("A", "x", "y"), "c2": ("D", "q", "q")}


def test_transaction_class_null_is_sell(spark):
    df = spark.createDataFrame([("Buy",), ("Sell",), (None,)], "t string")
    got = [r[0] for r in df.select(cleaning.transaction_class("t")).collect()]
    assert got == ["BuyTransaction", "SellTransaction", "SellTransaction"]


def test_microseconds_at_both_ends(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from kairos.functions.dates import CutoffGrid, asof_bucket, horizon_indexes, in_horizons
    grid = CutoffGrid(dt.date(2000, 3, 1), dt.date(2000, 2, 16), 14)
    cut, tick = dt.datetime(2000, 3, 1), dt.timedelta(microseconds=1)
    end = cut + dt.timedelta(days=180)
    times = [cut - tick, cut, cut + tick, cut + tick * 500_000, end - tick, end, end + tick, end + tick * 500_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, ts timestamp_ntz")
    got = {r.i: (0 in r.h, r.b, r.inside) for r in df.select(
        "i", horizon_indexes(grid, F.col("ts")).alias("h"), asof_bucket(grid, F.col("ts")).alias("b"),
        in_horizons(grid, F.col("ts")).alias("inside")).collect()}
    assert [got[i][0] for i in range(8)] == [False, False, True, True, True, True, False, False]
    assert [got[i][1] for i in range(4)] == [0, 0, None, None]
    assert all(inside or not hit for hit, _, inside in got.values())


def test_interval_join_equals_all_pairs(spark):
    import datetime as dt
    import random
    r = random.Random(3)
    at = lambda: dt.datetime(1969, 12, 1) + dt.timedelta(seconds=r.randint(0, 90 * 86400))
    facts = [(r.choice("aab"), i, at()) for i in range(150)] + [(None, 900, at()), ("a", 901, None)]
    spans = []
    for i in range(40):
        low = at()
        spans.append((r.choice("aabc"), 100 + i, low, low + dt.timedelta(seconds=r.choice([0, 1, 60, 86400, 2 * 86400, 86401, 40 * 86400, -5]))))
    spans += [("a", 500, facts[0][2], facts[0][2] + dt.timedelta(days=1)), ("a", 501, facts[0][2] - dt.timedelta(days=1), facts[0][2]), ("a", 502, None, at())]
    f = spark.createDataFrame(facts, "k string, f int, ts timestamp_ntz")
    s = spark.createDataFrame(spans, "k string, s int, low timestamp_ntz, high timestamp_ntz")
    got = temporal.interval_join(f, s, ["k"], "ts", "low", "high").select("f", "s").collect()
    want = [(x, y) for k, x, t in facts for q, y, lo, hi in spans if k == q and t and lo and lo < t <= hi]
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert temporal.interval_join(f, s.limit(0), ["k"], "ts", "low", "high").count() == 0


@pytest.mark.parametrize("strict,tolerance", [(False, None), (True, None), (True, 3), (False, 0)])
def test_asof_join_equals_brute_force(spark, strict, tolerance):
    import datetime as dt
    import random
    r = random.Random(8)
    at = lambda: dt.datetime(2001, 1, 1) + dt.timedelta(hours=r.randint(0, 600))
    left = [(i, r.choice(["hot", "hot", "b", "none", None]), at() if i % 17 else None) for i in range(200)]
    right = [(r.choice(["hot", "hot", "b", "c", None]), at() if i % 13 else None, float(r.randint(0, 9))) for i in range(150)]
    rf = spark.createDataFrame(right, "k string, at timestamp_ntz, price double")
    got = temporal.asof_join(spark.createDataFrame(left, "i int, k string, ts timestamp_ntz"), rf, ["k"], "ts", "at", ["price"], "price",
                             tolerance, strict, parts=7)
    want = []
    for i, k, t in left:
        m = [(u, p) for q, u, p in right if k is not None and q == k and t and u and (u < t or u == t and not strict)]
        best = max(m, default=(None, None))
        if best[0] and tolerance is not None and best[0] < t - dt.timedelta(days=tolerance):
            best = (None, None)
        want.append((i, k, t, *best))
    assert sorted(map(tuple, got.collect())) == sorted(want)
