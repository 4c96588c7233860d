"""Declared schemas of the domain tables (no inference on read)."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("transactionID", T.StringType(), False),
    T.StructField("customerID", T.StringType(), False),
    T.StructField("ISIN", T.StringType(), False),
    T.StructField("transactionType", T.StringType(), True),
    T.StructField("totalValue", T.DoubleType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), False),
])

CUSTOMER_INFORMATION = T.StructType([
    T.StructField("customerID", T.StringType(), False),
    T.StructField("customerType", T.StringType(), True),
    T.StructField("riskLevel", T.StringType(), True),
    T.StructField("investmentCapacity", T.StringType(), True),
    T.StructField("_ingest_seq", T.LongType(), True),
])

CLOSE_PRICES = T.StructType([
    T.StructField("ISIN", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("closePrice", T.DoubleType(), True),
])

ASSET_INFORMATION = T.StructType([
    T.StructField("ISIN", T.StringType(), True),
    T.StructField("assetCategory", T.StringType(), True),
    T.StructField("sector", T.StringType(), True),
    T.StructField("industry", T.StringType(), True),
    T.StructField("_ingest_seq", T.LongType(), True),
])

TURN = T.StructType([
    T.StructField("content", T.StringType(), True),
    T.StructField("role", T.StringType(), True),
])
CHAT = T.ArrayType(TURN)

RESPONSES = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("data_variant", T.StringType(), False),
    T.StructField("ablation", T.StringType(), False),
    T.StructField("example_id", T.StringType(), False),
    T.StructField("response", T.StringType(), True),
    T.StructField("n_tokens", T.IntegerType(), True),
])

QA_GENERATION = T.StructType([
    T.StructField("prompt", T.StringType(), True),
    T.StructField("gold", T.StringType(), True),
    T.StructField("output", T.StringType(), True),
    T.StructField("subset", T.StringType(), True),
])

FIT_METRICS = T.StructType([
    T.StructField("round", T.IntegerType(), False),
    T.StructField("client_id", T.IntegerType(), False),
    T.StructField("num_examples", T.LongType(), False),
    T.StructField("train_loss", T.DoubleType(), True),
])

TRAIT_COLUMNS = ["customerType", "riskLevel", "investmentCapacity"]
