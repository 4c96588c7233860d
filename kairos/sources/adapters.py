"""Domain views over the provided TPC-H-like tables.

The four domain inputs (transactions, customer traits, close prices, asset
attributes) are derived from lineitem / orders / customer / nation / region /
part so that every operator runs over the whole given tables. The oracle SQL
in ``kairos.plans.views_sql`` builds the same views in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def isin_of(partkey: Column) -> Column:
    """12 fixed characters, so substring tests between ISINs cannot collide."""
    return F.concat(F.lit("P"), F.lpad(partkey.cast("string"), 11, "0"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_returnflag", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("transactionID"),
        F.col("o_custkey").cast("string").alias("customerID"),
        isin_of(F.col("l_partkey")).alias("ISIN"),
        F.when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy").alias("transactionType"),
        F.col("l_extendedprice").alias("totalValue"),
        F.col("l_shipdate").alias("timestamp"),
    )


def close_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(isin_of(F.col("l_partkey")).alias("ISIN"), F.col("l_shipdate").alias("timestamp"))
            .agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("closePrice")))


def _capacity(bal: Column) -> Column:
    return (F.when(bal < 0, "Low").when(bal < 3000, "Medium")
            .when(bal < 6000, "High").otherwise("VeryHigh"))


def customer_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer in load order, plus a later, different row for every
    customer key divisible by 7 (keep-first must drop it)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    r = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    base = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    first = base.select(
        F.col("c_custkey").cast("string").alias("customerID"),
        F.col("c_mktsegment").alias("customerType"),
        F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("Predicted_"), "r_name"))
         .otherwise(F.col("r_name")).alias("riskLevel"),
        _capacity(F.col("c_acctbal")).alias("investmentCapacity"),
        (F.col("c_custkey") * 2).alias("_ingest_seq"))
    second = base.where(F.col("c_custkey") % 7 == 0).select(
        F.col("c_custkey").cast("string").alias("customerID"),
        F.concat(F.col("c_mktsegment"), F.lit("_REVISED")).alias("customerType"),
        F.concat(F.lit("Predicted_"), "r_name").alias("riskLevel"),
        F.lit("Unknown").alias("investmentCapacity"),
        (F.col("c_custkey") * 2 + 1).alias("_ingest_seq"))
    return first.unionByName(second)


def asset_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes per part; duplicate later rows for keys divisible by 11; keys
    divisible by 13 left out (assets with prices but no attributes)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    p = p.where(F.col("p_partkey") % 13 != 0)
    first = p.select(
        isin_of(F.col("p_partkey")).alias("ISIN"),
        F.col("p_type").alias("assetCategory"),
        F.col("p_brand").alias("sector"),
        F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("p_size").cast("string")).alias("industry"),
        (F.col("p_partkey") * 2).alias("_ingest_seq"))
    dup = p.where(F.col("p_partkey") % 11 == 0).select(
        isin_of(F.col("p_partkey")).alias("ISIN"),
        F.lit("DUPLICATE").alias("assetCategory"),
        F.col("p_brand").alias("sector"),
        F.lit(None).cast("string").alias("industry"),
        (F.col("p_partkey") * 2 + 1).alias("_ingest_seq"))
    return first.unionByName(dup)


def _neg_abs(arr: Column, start: int, length: int, scale: float) -> Column:
    return F.transform(F.slice(arr, start, length), lambda x: -F.abs(x).cast("double") * F.lit(scale))


def membership_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: label (vec label mod 2) and five token log-prob lists.

    The pretrained list is -|x| of the embedding; the tuned and lower-cased
    models read shifted, scaled slices of it.
    """
    e = table(spark, sf_dir, "embeddings")
    emb = F.col("embedding")
    return e.select(
        F.col("vec_id").alias("text_id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"),
        (F.col("label") % 2).cast("double").alias("label"),
        _neg_abs(emb, 1, 64, 1.0).alias("lp_pre"),
        _neg_abs(emb, 2, 63, 0.9).alias("lp_fl"),
        _neg_abs(emb, 3, 62, 0.8).alias("lp_cen"),
        _neg_abs(emb, 1, 60, 0.95).alias("lp_fl_lower"),
        _neg_abs(emb, 5, 60, 0.85).alias("lp_cen_lower"))


def qa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows from labelled documents: contexts = the document's lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    return j.select(
        "doc_id",
        F.split(F.col("text"), "\n").alias("CONTEXTS"),
        F.concat(F.lit("Is document "), F.col("doc_id").cast("string"), F.lit(" of good quality?")).alias("QUESTION"),
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("final_decision"),
        F.concat(F.lit("The document is "), F.when(F.col("toxic") == 1, "toxic").otherwise("not toxic"),
                 F.lit(".")).alias("LONG_ANSWER"),
        F.col("lang").alias("subset"))


# Candidate generations of the QA fixture.
QA_OUTPUTS = ["yes", "no", "yesyes", "yesno", "\n## yes", "unclear"]


def qa_generations(prompts: DataFrame, seed=2025) -> DataFrame:
    """(prompt, output): one generated answer per distinct prompt, chosen by hash."""
    from kairos.functions.hashing import hash_key
    idx = F.conv(F.substring(hash_key(seed, "prompt"), 1, 8), 16, 10).cast("long") % len(QA_OUTPUTS)
    outs = F.array(*[F.lit(o) for o in QA_OUTPUTS])
    return prompts.select("prompt").distinct().withColumn("output", F.get(outs, idx.cast("int")))


def fit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(round, client_id, num_examples, train_loss) per reported fit."""
    e = table(spark, sf_dir, "embeddings")
    loss = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select((F.lit(1) + F.col("vec_id") % 5).cast("int").alias("round"),
                    F.col("label").cast("int").alias("client_id"),
                    (F.lit(1) + F.col("vec_id") % 7).cast("long").alias("num_examples"),
                    loss.alias("train_loss"))


def parameter_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(round, client_id, param, values, num_examples) per reported fit."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.lit(1) + F.col("vec_id") % 5).cast("int").alias("round"),
                    F.col("label").cast("int").alias("client_id"),
                    F.lit("adapter").alias("param"),
                    F.col("embedding").alias("values"),
                    (F.lit(1) + F.col("vec_id") % 7).cast("long").alias("num_examples"))
