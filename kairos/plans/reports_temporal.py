"""Registered queries: sources, cleaning and the point-in-time label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos import schemas
from kairos.functions.dates import TEST_GRID, TRAIN_GRID
from kairos.functions.hashing import hash_bucket, sql_bucket
from kairos.operators import cleaning, temporal
from kairos.plans import views_sql as V
from kairos.plans.registry import dtxt, register, rnd, ttxt
from kairos.sources import adapters as A


def traits(spark, sf_dir):
    """Customer traits after keep-first and prefix removal (P1 then P3)."""
    first = cleaning.keep_first(A.customer_information(spark, sf_dir), "customerID")
    return cleaning.strip_token(first.drop("_ingest_seq"), schemas.TRAIT_COLUMNS)


def assets(spark, sf_dir):
    return cleaning.keep_first(A.asset_information(spark, sf_dir), "ISIN").drop("_ingest_seq")


@register("s1_transactions", V.with_views(f"""
    SELECT transactionID, customerID, ISIN, transactionType, {rnd('totalValue')} AS totalValue,
           {ttxt('"timestamp"')} AS "timestamp" FROM transactions"""))
def s1_transactions(spark, sf_dir):
    return A.transactions(spark, sf_dir)


@register("s2_customer_information", V.with_views("SELECT * FROM customer_information"))
def s2_customer_information(spark, sf_dir):
    return A.customer_information(spark, sf_dir)


@register("s3_close_prices", V.with_views(f"""
    SELECT ISIN, {ttxt('"timestamp"')} AS "timestamp", {rnd('closePrice')} AS closePrice FROM close_prices"""))
def s3_close_prices(spark, sf_dir):
    return A.close_prices(spark, sf_dir)


@register("s4_asset_information", V.with_views("SELECT * FROM asset_information"))
def s4_asset_information(spark, sf_dir):
    return A.asset_information(spark, sf_dir)


@register("p1_dedupe_keep_first", V.with_views("""
    SELECT customerID, arg_min(customerType, _ingest_seq) AS customerType,
           arg_min(riskLevel, _ingest_seq) AS riskLevel,
           arg_min(investmentCapacity, _ingest_seq) AS investmentCapacity
    FROM customer_information GROUP BY customerID"""))
def p1_dedupe_keep_first(spark, sf_dir):
    return cleaning.keep_first(A.customer_information(spark, sf_dir), "customerID").drop("_ingest_seq")


@register("p2_drop_duplicate_assets", V.with_views("SELECT * FROM assets"))
def p2_drop_duplicate_assets(spark, sf_dir):
    return assets(spark, sf_dir)


@register("p3_strip_token", V.with_views("SELECT * FROM traits"))
def p3_strip_token(spark, sf_dir):
    return traits(spark, sf_dir)


@register("p10_transaction_class", V.with_views("""
    SELECT transactionType, CASE WHEN transactionType = 'Buy' THEN 'BuyTransaction'
           ELSE 'SellTransaction' END AS transactionClass, count(*) AS n
    FROM transactions GROUP BY 1, 2"""))
def p10_transaction_class(spark, sf_dir):
    t = A.transactions(spark, sf_dir)
    return (t.groupBy("transactionType", cleaning.transaction_class("transactionType").alias("transactionClass"))
            .agg(F.count("*").alias("n")))


@register("a3_all_assets", V.with_views("SELECT DISTINCT ISIN FROM close_prices"))
def a3_all_assets(spark, sf_dir):
    return temporal.all_assets(A.close_prices(spark, sf_dir))


@register("j4_horizon_purchases", V.with_views(f"""
    SELECT {dtxt('cutoff')} AS cutoff, customerID, ISIN FROM ({V.purchases_sql('test_grid')})"""))
def j4_horizon_purchases(spark, sf_dir):
    return temporal.horizon_purchases(A.transactions(spark, sf_dir), TEST_GRID).drop("k")


@register("j4_horizon_purchases_train", V.with_views(f"""
    SELECT {dtxt('cutoff')} AS cutoff, customerID, ISIN FROM ({V.purchases_sql('train_grid')})"""))
def j4_horizon_purchases_train(spark, sf_dir):
    return temporal.horizon_purchases(A.transactions(spark, sf_dir), TRAIN_GRID).drop("k")


@register("j5_asof_start_prices", V.with_views(f"""
    SELECT {dtxt('cutoff')} AS cutoff, ISIN, {rnd('start_price')} AS start_price
    FROM ({V.start_sql('test_grid')})"""))
def j5_asof_start_prices(spark, sf_dir):
    return temporal.start_prices(A.close_prices(spark, sf_dir), TEST_GRID).drop("k")


@register("j6_forward_end_prices", V.with_views(f"""
    SELECT {dtxt('cutoff')} AS cutoff, ISIN, {rnd('end_price')} AS end_price
    FROM ({V.end_sql('test_grid')})"""))
def j6_forward_end_prices(spark, sf_dir):
    return temporal.end_prices(A.close_prices(spark, sf_dir), TEST_GRID).drop("k")


@register("j7_profitable_assets", V.with_views(f"""
    SELECT {dtxt('cutoff')} AS cutoff, ISIN, {rnd('start_price')} AS start_price,
           {rnd('end_price')} AS end_price FROM ({V.profitable_sql('test_grid')})"""))
def j7_profitable_assets(spark, sf_dir):
    return temporal.profitable_assets(A.close_prices(spark, sf_dir), TEST_GRID).drop("k")


@register("j8_good_assets", V.with_views(f"""
    SELECT {dtxt('cutoff')} AS cutoff, customerID, ISIN FROM ({V.good_sql('test_grid')})"""))
def j8_good_assets(spark, sf_dir):
    pur = temporal.horizon_purchases(A.transactions(spark, sf_dir), TEST_GRID)
    prof = temporal.profitable_assets(A.close_prices(spark, sf_dir), TEST_GRID)
    return temporal.good_assets(pur, prof).drop("k")


@register("a4_ten_week_summary", V.with_views(f"""
    WITH p AS (SELECT ISIN, CAST("timestamp" AS DATE) AS d, closePrice FROM close_prices),
    a AS (SELECT ISIN, min(d) + CAST((7 - isodow(min(d))) % 7 AS INTEGER) AS anchor FROM p GROUP BY ISIN),
    b AS (SELECT p.ISIN, p.d, p.closePrice,
                 a.anchor + CAST(70 * greatest(0, ceil(datediff('day', a.anchor, p.d) / 70.0)) AS INTEGER) AS period_end
          FROM p JOIN a USING (ISIN) WHERE p.closePrice IS NOT NULL)
    SELECT ISIN, {dtxt('period_end')} AS period_end, {rnd('arg_max(closePrice, d)')} AS end_price,
           {rnd('list_reduce(list(closePrice ORDER BY closePrice), lambda a, x: a + x, CAST(0.0 AS DOUBLE)) / count(closePrice)')} AS avg_price, {rnd('max(closePrice)')} AS high_price,
           {rnd('min(closePrice)')} AS low_price
    FROM b GROUP BY ISIN, period_end"""))
def a4_ten_week_summary(spark, sf_dir):
    return temporal.ten_week_summary(A.close_prices(spark, sf_dir))


IRREGULAR = {"own_cutoffs": f"""
    SELECT DISTINCT customerID, "timestamp" AS cutoff, 20 + {sql_bucket('horizon', 300, 'customerID')} AS horizon FROM transactions WHERE transactionType = 'Sell'"""}


@register("j4_interval_join", V.with_views("""
    SELECT c.customerID, strftime(c.cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff, c.horizon, count(*) AS n_bought, count(DISTINCT t.ISIN) AS n_assets
    FROM own_cutoffs c JOIN transactions t ON t.customerID = c.customerID AND t."timestamp" > c.cutoff
      AND t."timestamp" <= c.cutoff + to_days(c.horizon::INTEGER)
    WHERE t.transactionType = 'Buy' GROUP BY ALL""", IRREGULAR))
def j4_interval_join(spark, sf_dir):
    """What each customer bought after each of its sales, in a horizon of its own: no grid on either side."""
    tx = A.transactions(spark, sf_dir)
    days = 20 + hash_bucket("horizon", 300, "customerID")
    cuts = tx.where("transactionType = 'Sell'").select("customerID", F.col("timestamp").alias("cutoff"), days.cast("int").alias("horizon")).distinct()
    cuts = cuts.withColumn("until", F.col("cutoff") + F.make_dt_interval(F.col("horizon")))
    found = temporal.interval_join(tx.where("transactionType = 'Buy'").select("customerID", "ISIN", "timestamp"), cuts, ["customerID"],
                                   "timestamp", "cutoff", "until")
    return found.groupBy("customerID", "cutoff", "horizon").agg(F.count("*").alias("n_bought"), F.countDistinct("ISIN").alias("n_assets")).withColumn(
        "cutoff", F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss"))


def _pooled(isin: str) -> str:
    return f"CASE WHEN {sql_bucket('pool', 3, isin)} = 0 THEN 'POOL' ELSE {isin} END"


@register("j5_asof_join", V.with_views(f"""
    SELECT transactionID, strftime(m.ts, '%Y-%m-%d %H:%M:%S') AS matched_timestamp, {rnd('m.price')} AS closePrice FROM (
      SELECT t.transactionID, CASE WHEN p.ts >= t."timestamp" - INTERVAL 30 DAY THEN p.ts END AS ts,
             CASE WHEN p.ts >= t."timestamp" - INTERVAL 30 DAY THEN p.price END AS price
      FROM (SELECT transactionID, "timestamp", {_pooled('ISIN')} AS series FROM transactions) t
      ASOF LEFT JOIN (SELECT {_pooled('ISIN')} AS series, "timestamp" AS ts, max(closePrice) AS price FROM close_prices GROUP BY 1, 2) p
        ON p.series = t.series AND t."timestamp" > p.ts) m"""))
def j5_asof_join(spark, sf_dir):
    """Each transaction's last price before it, of 30 days at most. A third of the assets are pooled in one series, whose days have many prices."""
    pooled = F.when(hash_bucket("pool", 3, "ISIN") == 0, F.lit("POOL")).otherwise(F.col("ISIN"))
    tx = A.transactions(spark, sf_dir).select("transactionID", "timestamp", pooled.alias("series"))
    prices = A.close_prices(spark, sf_dir).select(pooled.alias("series"), "timestamp", "closePrice")
    found = temporal.asof_join(tx, prices, ["series"], "timestamp", "timestamp", ["closePrice"], tie="closePrice", tolerance_days=30, strict=True)
    return found.select("transactionID", F.date_format("matched_timestamp", "yyyy-MM-dd HH:mm:ss").alias("matched_timestamp"), "closePrice")
