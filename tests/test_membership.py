import itertools
import math

from pyspark.sql import functions as F

from kairos.operators import membership


def pairwise_auc(rows):
    pos = [s for l, s in rows if l == 1]
    neg = [s for l, s in rows if l == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def long(spark, rows, metric="m"):
    return spark.createDataFrame([(metric, float(l), s) for l, s in rows], "metric string, label double, score double")


def test_auc_with_ties_equals_pairwise(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1), (1, 0.95), (0, 0.5)]
    s = membership.roc_summary(membership.roc_curve(long(spark, rows), n_ranges=3)).collect()[0]
    assert abs(s.auc - pairwise_auc(rows)) < 1e-12
    assert 0.5 <= s.balanced_accuracy <= 1


def test_auc_invariant_to_monotone_transform(spark):
    rows = [(i % 2, (i * 37 % 11) / 11.0) for i in range(60)]
    a = membership.roc_summary(membership.roc_curve(long(spark, rows))).collect()[0].auc
    b = membership.roc_summary(membership.roc_curve(long(spark, [(l, math.exp(3 * s)) for l, s in rows]))).collect()[0].auc
    assert abs(a - b) < 1e-12


def test_one_class_gives_null(spark):
    s = membership.roc_summary(membership.roc_curve(long(spark, [(1, 0.2), (1, 0.4)]))).collect()[0]
    assert s.auc is None and s.balanced_accuracy is None


def test_tpr_at_low_fpr_and_curve(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.1)]
    c = membership.roc_curve(long(spark, rows)).orderBy(F.desc("score")).collect()
    assert [(r.tpr, r.fpr) for r in c][:2] == [(1 / 3, 0.0), (2 / 3, 0.0)]
    s = membership.roc_summary(membership.roc_curve(long(spark, rows))).collect()[0]
    assert abs(s.tpr_at_low_fpr - 2 / 3) < 1e-12


def test_nan_dropped_per_metric(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, float("nan")), (2, 0.0, 0.2, 0.3)],
                               "text_id int, label double, a double, b double")
    l = membership.long_scores(df, ["text_id"], ["a", "b"])
    assert dict(l.groupBy("metric").count().collect()) == {"a": 2, "b": 1}


def test_metric_column_selection():
    cols = ["text_id", "label", "raw_x", "raw_clf", "perp_a", "pre_to_fl_score"]
    assert membership.metric_columns(cols) == ["raw_clf", "pre_to_fl_score"]


def test_perplexity_and_flag(spark):
    df = spark.createDataFrame([([-1.0, -1.0], [-2.0, -2.0])], "m array<double>, p array<double>")
    r = membership.membership_flags(df, "m", "p").collect()[0]
    assert abs(r.ratio - math.exp(1) / math.exp(2)) < 1e-12 and r.membership
    assert r.message == "Normalised Perplexity: 0.37 -->  Membership: True"


def test_corners_are_what_a_thinned_curve_keeps(spark):
    import random
    r = random.Random(4)
    for n_ranges in (1, 3, 40):
        rows = [(r.randint(0, 1), r.randint(0, 25) / 10) for _ in range(60)] + [(1, 9.0), (1, 8.0), (1, 7.0), (0, -1.0), (0, -2.0), (0, -3.0)]
        got = {p["score"]: p["corner"] for p in membership.roc_curve(long(spark, rows), n_ranges).collect()}
        scores = sorted({s for _, s in rows}, reverse=True)
        tps = list(itertools.accumulate(sum(l == 1 and x == s for l, x in rows) for s in scores))
        fps = list(itertools.accumulate(sum(l == 0 and x == s for l, x in rows) for s in scores))
        bent = lambda c, i: c[i + 1] - 2 * c[i] + c[i - 1] != 0
        want = {s: i in (0, len(scores) - 1) or bent(tps, i) or bent(fps, i) for i, s in enumerate(scores)}
        assert got == want and not all(want.values())


def test_low_fpr_reads_the_corners(spark):
    # ten negatives one after the other below a positive: the points between the ends are on a line
    rows = [(1, 100.0), (0, 99.0), (1, 98.0)] + [(0, 50.0 - i) for i in range(99)]
    s = membership.roc_summary(membership.roc_curve(long(spark, rows), n_ranges=4)).collect()[0]
    assert s.tpr_at_low_fpr == 1.0
    line = [(1, 10.0 - i) for i in range(5)]
    s = membership.roc_summary(membership.roc_curve(long(spark, line + [(0, -1.0)]), n_ranges=2)).collect()[0]
    assert s.tpr_at_low_fpr == 1.0
