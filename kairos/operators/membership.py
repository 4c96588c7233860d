"""Membership-inference scoring.

Log-probabilities arrive as array columns; perplexities, ratios and the ROC
statistics are aggregates. The ROC cumulative sums never put a whole metric
into one task: scores are cut into ranges by approximate quantiles, range
totals give each range its offset, and only a range is ranked at a time
(exact for any cut points; the quantiles only balance the work).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_COLUMNS = ["pre_to_fl_score", "pre_to_cen_score", "fl_log_lower_score", "cen_log_lower_score"]


def perplexity(lp: Column) -> Column:
    """exp(-mean(log-probs)) (A20); null for an empty list."""
    total = F.aggregate(lp, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.exp(-F.try_divide(total, F.size(lp)))


def scores(df: DataFrame) -> DataFrame:
    """Ratios of perplexities (F15): needs lp_pre, lp_fl, lp_cen, lp_fl_lower, lp_cen_lower."""
    ppl = {c: perplexity(F.col(f"lp_{c}")) for c in ["pre", "fl", "cen", "fl_lower", "cen_lower"]}
    x = df.withColumns({f"ppl_{k}": v for k, v in ppl.items()})
    return x.withColumns({
        "pre_to_fl_score": F.try_divide(F.col("ppl_pre"), F.col("ppl_fl")),
        "pre_to_cen_score": F.try_divide(F.col("ppl_pre"), F.col("ppl_cen")),
        "fl_log_lower_score": F.try_divide(F.log(F.col("ppl_fl")), F.log(F.col("ppl_fl_lower"))),
        "cen_log_lower_score": F.try_divide(F.log(F.col("ppl_cen")), F.log(F.col("ppl_cen_lower"))),
    })


def metric_columns(columns: list[str]) -> list[str]:
    """Columns that are metrics (F26): not raw (unless clf), perp, label or text."""
    return [c for c in columns
            if not (("raw" in c and "clf" not in c) or "perp" in c or "label" in c or "text" in c)]


def long_scores(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """(ids..., label, metric, score) with NaN / null scores dropped per metric."""
    long = df.unpivot([*ids, "label"], metrics, "metric", "score")
    return long.where(F.col("score").isNotNull() & ~F.isnan("score"))


RANGE_ROWS = 1_000_000  # scores that one task may cumulate


def roc_curve(long: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """(metric, score, tpr, fpr, corner) per distinct score, descending thresholds.

    ``corner`` is false for a point on the line between its neighbours: the
    next point adds as many positives and negatives as it did itself, so the
    second difference is zero in both. Each score range hands its first
    point's counts to the last point of the range above. The ends are corners.

    Ties share one point. The (0, 0) point at threshold +inf is not a row; the
    summaries below add it. The number of score ranges follows the row count.
    """
    if n_ranges is None:
        n_ranges = max(64, -(-long.count() // RANGE_ROWS))
    pts = long.groupBy("metric", "score").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).cast("long").alias("neg"))
    probs = [i / n_ranges for i in range(1, n_ranges)]
    cuts = long.groupBy("metric").agg(F.percentile_approx("score", probs, max(1000, 4 * n_ranges)).alias("cuts"))
    x = pts.join(cuts, "metric").withColumn(
        "rng", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("score"))), F.lit(0))).drop("cuts")
    step = F.struct("pos", "neg")
    per = x.groupBy("metric", "rng").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"), F.max_by(step, "score").alias("first"))
    wm = Window.partitionBy("metric")
    above = Window.partitionBy("metric").orderBy(F.col("rng").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    below = F.lead("first").over(Window.partitionBy("metric").orderBy(F.col("rng").desc()))
    per = per.select("metric", "rng", below.alias("below"),
                     F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("op"),
                     F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("on"),
                     F.sum("rp").over(wm).alias("P"), F.sum("rn").over(wm).alias("N"))
    inner = Window.partitionBy("metric", "rng").orderBy(F.col("score").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    y = x.join(per, ["metric", "rng"]).withColumns({
        "cp": F.col("op") + F.sum("pos").over(inner), "cn": F.col("on") + F.sum("neg").over(inner),
        "next": F.coalesce(F.lead(step).over(Window.partitionBy("metric", "rng").orderBy(F.col("score").desc())), "below")})
    first = (F.col("cp") == F.col("pos")) & (F.col("cn") == F.col("neg"))
    y = y.withColumn("corner", first | F.col("next").isNull() | (F.col("next") != step))
    return y.select("metric", "score", "pos", "neg", "cp", "cn", "corner",
                    F.try_divide(F.col("cp"), F.col("P")).alias("tpr"),
                    F.try_divide(F.col("cn"), F.col("N")).alias("fpr"),
                    "P", "N")


def roc_summary(curve: DataFrame, low_fpr: float = 0.05) -> DataFrame:
    """(metric, auc, balanced_accuracy, tpr_at_low_fpr, n_pos, n_neg).

    The trapezoid between a point and its predecessor is
    neg * (2 * cum_pos - pos) / (2 P N), so the AUC is a plain sum over the
    points (no lag, no window); the curve includes (0, 0), so the maxima
    start at 0.5 and 0. Null when a class is missing. The TPR below the low
    FPR is read off the corners alone, as from a curve without its collinear
    points; the other two don't change with those.
    """
    trap = F.try_divide(F.col("neg") * (2 * F.col("cp") - F.col("pos")), 2.0 * F.col("P") * F.col("N"))
    bacc = 1 - (F.col("fpr") + 1 - F.col("tpr")) / 2
    return curve.groupBy("metric").agg(
        F.sum(trap).alias("auc"),
        F.greatest(F.max(bacc), F.lit(0.5)).alias("balanced_accuracy"),
        F.greatest(F.max(F.when((F.col("fpr") < low_fpr) & F.col("corner"), F.col("tpr"))), F.lit(0.0)).alias("tpr_at_low_fpr"),
        F.max("P").alias("n_pos"), F.max("N").alias("n_neg"),
    ).withColumn("valid", (F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(
        "metric", *[F.when(F.col("valid"), F.col(c)).alias(c)
                    for c in ["auc", "balanced_accuracy", "tpr_at_low_fpr"]], "n_pos", "n_neg")


def membership_flags(df: DataFrame, model_lp: str, pre_lp: str) -> DataFrame:
    """ratio = ppl(model) / ppl(pretrained); membership = ratio < 1, with the message text."""
    ratio = F.try_divide(perplexity(F.col(model_lp)), perplexity(F.col(pre_lp)))
    x = df.withColumn("ratio", ratio).withColumn("membership", F.col("ratio") < 1)
    return x.withColumn("message", F.format_string(
        "Normalised Perplexity: %.2f -->  Membership: %s", F.col("ratio"),
        F.when(F.col("membership"), "True").otherwise("False")))
