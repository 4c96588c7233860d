"""Registered queries: cohorts, sampling and the example label lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos.functions.dates import TEST_GRID, TRAIN_GRID, date_text
from kairos.functions.hashing import sql_hash, sql_uniform
from kairos.operators import cohorts, temporal
from kairos.plans import datasets as D
from kairos.plans import views_sql as V
from kairos.plans.registry import dtxt, register
from kairos.plans.reports_temporal import traits
from kairos.session import build_once
from kairos.sources import adapters as A

S = D.SEED


def assigned(spark, sf_dir, iid=False):
    return build_once(cohorts.assign_clients(traits(spark, sf_dir), A.transactions(spark, sf_dir), iid=iid), "assigned")


def _e1_sql(iid: bool) -> str:
    raw = "1.0" if iid else sql_uniform(S, "'bias'", "trait", "value", "c")
    return f"""
    SELECT customerID, CAST(least(count_if(cdf <= u), 19) AS INTEGER) AS client_id FROM (
      SELECT customerID, u, cum / last_value(cum) OVER (PARTITION BY customerID ORDER BY c
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cdf FROM (
        SELECT customerID, c, {sql_uniform(S, "'draw'", 'customerID')} AS u,
               sum(p) OVER (PARTITION BY customerID ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM (SELECT customerID, c, s / sum(s) OVER (PARTITION BY customerID) AS p FROM (
          SELECT l.customerID, wn.c, sum(wn.w) AS s
          FROM tlong l JOIN (
            SELECT trait, value, c, raw / sum(raw) OVER (PARTITION BY trait, value) AS w FROM (
              SELECT trait, value, c, {raw} AS raw
              FROM (SELECT DISTINCT trait, value FROM tlong) v CROSS JOIN range(0, 20) r(c))) wn
          ON l.trait = wn.trait AND l.value IS NOT DISTINCT FROM wn.value
          GROUP BY 1, 2))))
    GROUP BY customerID"""


_ACTIVE = {
    "tactive": "SELECT * FROM traits WHERE customerID IN (SELECT customerID FROM transactions)",
    "tlong": """SELECT customerID, 'customerType' AS trait, customerType AS value FROM tactive
                UNION ALL SELECT customerID, 'riskLevel', riskLevel FROM tactive
                UNION ALL SELECT customerID, 'investmentCapacity', investmentCapacity FROM tactive""",
}
E1 = {**_ACTIVE, "e1": _e1_sql(False)}


@register("e1_assign_clients", V.with_views("SELECT * FROM e1", E1))
def e1_assign_clients(spark, sf_dir):
    return assigned(spark, sf_dir).select("customerID", "client_id")


@register("e1_assign_clients_iid", V.with_views("SELECT * FROM e1i", {**_ACTIVE, "e1i": _e1_sql(True)}))
def e1_assign_clients_iid(spark, sf_dir):
    return assigned(spark, sf_dir, iid=True).select("customerID", "client_id")


@register("a2_distinct_trait_values", V.with_views("""
    SELECT DISTINCT 'customerType' AS trait, customerType AS value FROM traits
    UNION SELECT DISTINCT 'riskLevel', riskLevel FROM traits
    UNION SELECT DISTINCT 'investmentCapacity', investmentCapacity FROM traits"""))
def a2_distinct_trait_values(spark, sf_dir):
    return cohorts.distinct_trait_values(traits(spark, sf_dir))


@register("a6_client_sizes", V.with_views("""
    SELECT CAST(r.c AS INTEGER) AS client_id, count(e1.customerID) AS n_customers
    FROM range(0, 20) r(c) LEFT JOIN e1 ON e1.client_id = r.c GROUP BY 1""", E1))
def a6_client_sizes(spark, sf_dir):
    return cohorts.client_sizes(assigned(spark, sf_dir))


@register("a7_trait_histogram", V.with_views("""
    SELECT CAST(r.c AS INTEGER) AS client_id, v.trait, v.value,
           count(l.customerID) AS n_customers
    FROM (SELECT DISTINCT trait, value FROM tlong) v CROSS JOIN range(0, 20) r(c)
    LEFT JOIN (SELECT tlong.*, e1.client_id FROM tlong JOIN e1 USING (customerID)) l
      ON l.trait = v.trait AND l.value = v.value AND l.client_id = r.c
    GROUP BY 1, 2, 3""", E1))
def a7_trait_histogram(spark, sf_dir):
    return cohorts.trait_histogram(assigned(spark, sf_dir))


SAMPLED = {**E1, "sampled": f"""
    SELECT client_id, k, customerID FROM (
      SELECT e1.client_id, g.k, e1.customerID,
             row_number() OVER (PARTITION BY e1.client_id, g.k
                                ORDER BY {sql_hash(S, 'e1.client_id', 'g.k', 'e1.customerID')}) AS r,
             count(*) OVER (PARTITION BY e1.client_id, g.k) AS n
      FROM e1 CROSS JOIN train_grid g) WHERE r <= n // 5"""}


@register("r3_sample_customers", V.with_views("SELECT * FROM sampled", SAMPLED))
def r3_sample_customers(spark, sf_dir):
    return D.sampled_customers(assigned(spark, sf_dir), TRAIN_GRID)


def _eid(c="customerID", d="cutoff"):
    return f"({c} || '@' || strftime({d}, '%Y-%m-%d'))"


TRAIN = {**SAMPLED,
         "tgood": f"""SELECT {_eid('g.customerID', 'g.cutoff')} AS example_id, g.k, g.cutoff, g.customerID, g.ISIN
                      FROM ({V.good_sql('train_grid')}) g
                      WHERE EXISTS (SELECT 1 FROM sampled s WHERE s.k = g.k AND s.customerID = g.customerID)""",
         "tex": """SELECT DISTINCT t.example_id, t.k, t.cutoff, t.customerID, s.client_id
                   FROM tgood t JOIN sampled s ON s.k = t.k AND s.customerID = t.customerID""",
         "goodcap": f"""SELECT example_id, ISIN FROM tgood
                        QUALIFY row_number() OVER (PARTITION BY example_id
                                ORDER BY {sql_hash(f'{S}|good', 'example_id', 'ISIN')}) <= 20""",
         "anum": f"""SELECT ISIN, row_number() OVER (ORDER BY {sql_hash(f'{S}|bad|asset', 'ISIN')}) - 1 AS pos
                     FROM (SELECT DISTINCT ISIN FROM close_prices)""",
         "badentry": f"""SELECT example_id, need, s, m, keys, unnest(range(0, least(need + s.spare, s.a * s.b))) AS j FROM (
                           SELECT example_id, need, {V.keys_sql(f'{S}|bad', 'example_id')} AS keys FROM (SELECT example_id, count(*) + 20 AS need FROM tgood GROUP BY 1)),
                           (SELECT m, {V.shape_sql('m')} AS s FROM (SELECT count(*) AS m FROM anum)) WHERE m > 0""",
         "badpick": f"""SELECT e.example_id, a.ISIN FROM ({V.drawn_sql("SELECT * FROM badentry")}) e JOIN anum a USING (pos)
                        WHERE e.pos < e.m AND NOT EXISTS (SELECT 1 FROM tgood g WHERE g.example_id = e.example_id AND g.ISIN = a.ISIN)
                        QUALIFY row_number() OVER (PARTITION BY e.example_id ORDER BY e.j) <= 20"""}


@register("e2_train_labels", V.with_views(f"""
    SELECT e.example_id, e.client_id, {dtxt('e.cutoff')} AS cutoff, e.customerID, l.label,
           string_agg(l.ISIN, ',' ORDER BY l.ISIN) AS assets, count(*) AS n_assets
    FROM tex e JOIN (SELECT example_id, ISIN, true AS label FROM goodcap
                     UNION ALL SELECT example_id, ISIN, false FROM badpick) l USING (example_id)
    GROUP BY ALL""", TRAIN))
def e2_train_labels(spark, sf_dir):
    tx, pr = A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir)
    lab = D.train_labels(tx, pr, assigned(spark, sf_dir))
    # each side is a list per example before the two meet: single assets are not dealt out again
    lists = [x.groupBy("example_id").agg(F.array_join(F.array_sort(F.collect_list("ISIN")), ",").alias("assets"), F.count("*").alias("n_assets"))
             .select("example_id", F.lit(label).alias("label"), "assets", "n_assets")
             for x, label in ((D.capped_good(lab), True), (D.bad_assets(lab, temporal.all_assets(pr)), False))]
    lists = lists[0].unionByName(lists[1])
    return lab.examples.select("example_id", "client_id", "cutoff", "customerID").join(lists, "example_id")


TEST = {"xgood": f"""SELECT {_eid('customerID', 'cutoff')} AS example_id, k, cutoff, customerID, ISIN
                     FROM ({V.good_sql('test_grid')})""",
        "xex": "SELECT DISTINCT example_id, k, cutoff, customerID FROM xgood",
        "xpur": f"""SELECT {_eid('customerID', 'cutoff')} AS example_id, ISIN FROM ({V.purchases_sql('test_grid')})""",
        "xprof": f"SELECT k, count(*) AS n_profitable FROM ({V.profitable_sql('test_grid')}) GROUP BY k"}


@register("e4_test_examples", V.with_views(f"""
    SELECT e.example_id, {dtxt('e.cutoff')} AS cutoff, e.customerID,
           (SELECT string_agg(ISIN, ',' ORDER BY ISIN) FROM xpur p WHERE p.example_id = e.example_id) AS future_purchases,
           (SELECT string_agg(ISIN, ',' ORDER BY ISIN) FROM xgood g WHERE g.example_id = e.example_id) AS completion,
           (SELECT count(*) FROM xpur p WHERE p.example_id = e.example_id) AS n_future,
           (SELECT count(*) FROM xgood g WHERE g.example_id = e.example_id) AS n_good,
           x.n_profitable
    FROM xex e JOIN xprof x USING (k)""", TEST))
def e4_test_examples(spark, sf_dir):
    lab = D.test_labels(A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir))
    fut = lab.purchases.groupBy("example_id").agg(
        F.array_join(F.array_sort(F.collect_list("ISIN")), ",").alias("future_purchases"),
        F.count("*").alias("n_future"))
    comp = lab.good.groupBy("example_id").agg(
        F.array_join(F.array_sort(F.collect_list("ISIN")), ",").alias("completion"),
        F.count("*").alias("n_good"))
    nprof = lab.profitable.groupBy("k").agg(F.count("*").alias("n_profitable"))
    return (lab.examples.join(fut, "example_id").join(comp, "example_id").join(nprof, "k")
            .select("example_id", "cutoff", "customerID", "future_purchases", "completion",
                    "n_future", "n_good", "n_profitable"))


@register("a8_examples_per_date", V.with_views(f"""
    SELECT {dtxt('cutoff')} AS cutoff, count(*) AS n_examples FROM xex GROUP BY cutoff""", TEST))
def a8_examples_per_date(spark, sf_dir):
    lab = D.test_labels(A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir))
    return lab.examples.groupBy("cutoff").agg(F.count("*").alias("n_examples"))


SMALL = {**TEST, "xsmall": f"""
    SELECT example_id, k, cutoff, customerID FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY {sql_hash(f'{S}|small', 'k', 'example_id')}) AS r,
             count(*) OVER (PARTITION BY k) AS n FROM xex) WHERE r <= floor(n * 0.01)"""}


@register("e5_small_test_examples", V.with_views(f"""
    SELECT example_id, {dtxt('cutoff')} AS cutoff, customerID FROM xsmall""", SMALL))
def e5_small_test_examples(spark, sf_dir):
    lab = D.test_labels(A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir))
    return D.small_sample(lab.examples).select("example_id", "cutoff", "customerID")


def _train_rows(spark, sf_dir):
    """(client_id, example_id, label): the two labelled rows every train example yields."""
    tx, pr = A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir)
    lab = D.train_labels(tx, pr, assigned(spark, sf_dir))
    return lab.examples.select("client_id", "example_id").withColumn(
        "label", F.explode(F.array(F.lit(True), F.lit(False))))


ROWS2 = {**TRAIN, "trows": """SELECT client_id, example_id, l.label FROM tex
                              CROSS JOIN (SELECT unnest([true, false]) AS label) l"""}


@register("a9_partition_sizes", V.with_views("""
    SELECT client_id, count(*) AS n_rows FROM trows GROUP BY client_id""", ROWS2))
def a9_partition_sizes(spark, sf_dir):
    return _train_rows(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("n_rows"))


@register("a19_class_weights", V.with_views("""
    SELECT client_id, D, U,
           CASE WHEN D < U THEN CASE WHEN D = 0 THEN NULL ELSE U / D END ELSE 1.0 END AS desirable_weight,
           CASE WHEN D < U THEN 1.0 ELSE CASE WHEN U = 0 THEN NULL ELSE D / U END END AS undesirable_weight
    FROM (SELECT client_id, CAST(3 * count_if(label) AS BIGINT) AS D,
                 CAST(4 * (count(*) - count_if(label)) AS BIGINT) AS U FROM trows GROUP BY client_id)""", ROWS2))
def a19_class_weights(spark, sf_dir):
    from kairos.operators import federated
    return federated.class_weights(_train_rows(spark, sf_dir))


@register("r6_train_test_split", V.with_views(f"""
    SELECT client_id, example_id, label,
           CASE WHEN row_number() OVER (PARTITION BY client_id
                     ORDER BY {sql_hash(1234, 'client_id', 'example_id', 'label')}) <= ceil(count(*) OVER (PARTITION BY client_id) * 0.1)
                THEN 'test' ELSE 'train' END AS split
    FROM trows""", ROWS2))
def r6_train_test_split(spark, sf_dir):
    from kairos.operators import sampling
    train, test = sampling.train_test_split(_train_rows(spark, sf_dir), "client_id", 1234,
                                            ["example_id", "label"], 0.1)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
