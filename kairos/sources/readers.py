"""File readers for the domain tables and the evaluation inputs.

All readers take a declared schema; CSV and Parquet share one entry point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairos import schemas


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, **options) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.schema(schema).load(path)


def read_transactions(spark, path, fmt="csv") -> DataFrame:
    return _read(spark, path, schemas.TRANSACTIONS, fmt)


def _in_load_order(df: DataFrame, order_column: str | None) -> DataFrame:
    """Add ``_ingest_seq``, which keep-first goes by.

    It is ``order_column`` where given. Without one, it is the place in the
    input file, which only tells the order within one file: several files
    are refused.
    """
    if order_column is not None:
        return df.withColumn("_ingest_seq", F.col(order_column).cast("long"))
    if len(df.inputFiles()) > 1:
        raise ValueError("several input files have no load order; name an order_column")
    # the start of the file's block, then the place within it
    return df.withColumn("_ingest_seq", F.struct(F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row")))


def read_customers(spark, path, fmt="csv", columns=tuple(schemas.TRAIT_COLUMNS), order_column=None) -> DataFrame:
    """Only the key and trait columns are kept (the source prunes the rest); ``_ingest_seq``: see ``_in_load_order``."""
    fields = [f for f in schemas.CUSTOMER_INFORMATION.fields if f.name != "_ingest_seq"]
    if order_column is not None and order_column not in [f.name for f in fields]:
        fields.append(T.StructField(order_column, T.LongType()))
    df = _in_load_order(_read(spark, path, T.StructType(fields), fmt, enforceSchema="false"), order_column)
    return df.select("customerID", *columns, "_ingest_seq")


def read_prices(spark, path, fmt="csv") -> DataFrame:
    return _read(spark, path, schemas.CLOSE_PRICES, fmt)


def read_assets(spark, path, fmt="csv", order_column=None) -> DataFrame:
    fields = [f for f in schemas.ASSET_INFORMATION.fields if f.name != "_ingest_seq"]
    known = [f.name for f in fields]
    if order_column is not None and order_column not in known:
        fields.append(T.StructField(order_column, T.LongType()))
    df = _in_load_order(_read(spark, path, T.StructType(fields), fmt, enforceSchema="false"), order_column)
    return df.select(*known, "_ingest_seq")


def read_jsonl(spark, path, schema: T.StructType) -> DataFrame:
    """Strict JSON lines: the first malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark, path, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad raw lines): malformed lines are reported, not fatal.

    Lines are read as text and parsed by expression, so that neither result
    needs a cached copy of the input.
    """
    corrupt = "_corrupt_record"
    full = T.StructType(schema.fields + [T.StructField(corrupt, T.StringType(), True)])
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("row"))
    good = lines.where(F.col(f"row.{corrupt}").isNull()).select(*[F.col(f"row.{f.name}") for f in schema.fields])
    bad = lines.where(F.col(f"row.{corrupt}").isNotNull()).select(F.col(f"row.{corrupt}").alias("line"))
    return good, bad


def read_jsonl_shuffled(spark, path, schema: T.StructType, seed=0, keys: list[str] | None = None, position: str | None = None) -> DataFrame:
    """JSON lines in a seeded order of ``keys`` (all columns by default), whatever the file splits; equal rows stay together.

    With ``position`` also each row's place in that order, from 0.
    """
    from kairos.operators import sampling
    df = read_jsonl(spark, path, schema).withColumn("_key", F.to_json(F.struct(*(keys or [f.name for f in schema.fields]))))
    return sampling.seeded_shuffle(df, seed, "_key", position).drop("_key")


def read_scores_csv(spark, path, schema: T.StructType | None = None) -> DataFrame:
    """CSV quoted with '|'; rows with any null are dropped."""
    reader = spark.read.option("header", "true").option("quote", "|")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path).na.drop("any")


def read_subsets(spark, paths: dict[str, str], fmt="parquet", schema=None) -> DataFrame:
    """Each subset read, tagged with its name, union by column name."""
    out = None
    for name, p in paths.items():
        r = spark.read.format(fmt)
        if schema is not None:
            r = r.schema(schema)
        df = r.load(p).withColumn("subset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_responses(spark, path, fmt="json") -> DataFrame:
    return spark.read.format(fmt).schema(schemas.RESPONSES).load(path)


def read_examples(spark, path, schema: T.StructType, fmt="json") -> DataFrame:
    """Written examples back as rows; partition discovery restores the layout column."""
    return spark.read.format(fmt).schema(schema).load(path) if fmt != "json" else \
        spark.read.schema(schema).json(path)


def read_split(spark, train_path, test_path, fmt="parquet") -> tuple[DataFrame, DataFrame]:
    """A split that ``writers.save_split`` wrote, as (train, test)."""
    return spark.read.format(fmt).load(train_path), spark.read.format(fmt).load(test_path)


# One JSON string, as it stands in a file, and a key whose list is empty.
_STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_EMPTY = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:\s*\[\s*\]'
_OPENING = rf'(?s)^\s*\{{(?:\s*{_EMPTY}\s*,)*+\s*{_STRING}\s*:\s*\[\s*\{{\s*$'
_ELEMENT = (rf'(?s)^(.*\}})\s*(?:,\s*\{{|\](?:\s*,\s*{_EMPTY})*+\s*'
            rf'(?:,\s*{_STRING}\s*:\s*\[\s*\{{|\}}))\s*$')


def read_keyed_json(spark, path, schema: T.StructType | str, first: str, key: str) -> DataFrame:
    """The elements of ``{"key": [element, ...], ...}`` files with their key, one large file read by many tasks.

    ``first`` names the field that every element starts with, and that occurs
    as a field nowhere else. Its quoted name with a colon can't stand inside a
    JSON string, where quotes are escaped, so it is a border between elements
    that a task finds from any byte of the file: the text source cuts there.
    What follows an element in its piece tells whether a new key begins; the
    last key of each split is carried to the splits after it, one row a split.

    Any white space between the parts will do. Keys hold no braces; a key
    that occurs twice gives the elements of both lists; empty lists and empty
    objects give no rows; an element that is no JSON fails the job.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    border = f'"{first}":'
    pieces = spark.read.option("lineSep", border).text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"), "value")
    opens = F.regexp_extract("value", _OPENING, 1)
    # a key stands in quotes: taken apart from "no key" and with its escapes read by parsing it as a list
    quoted = F.when(F.col("value").rlike(_OPENING), opens).otherwise(
        F.when(F.regexp_extract("value", _ELEMENT, 2) != "", F.regexp_extract("value", _ELEMENT, 2)))
    read = F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>")[0]
    pieces = pieces.withColumn("_next", read).withColumn("_element", ~F.col("value").rlike(_OPENING))

    by_split = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    last = pieces.groupBy("_file", "_start").agg(F.max_by("_next", F.when(F.col("_next").isNotNull(), F.col("_place"))).alias("_last"))
    carried = last.select("_file", "_start", F.last("_last", ignorenulls=True).over(by_split).alias("_carried"))
    within = Window.partitionBy("_file", "_start").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    keyed = pieces.withColumn("_own", F.last("_next", ignorenulls=True).over(within)).where("_element")
    keyed = keyed.join(carried, ["_file", "_start"], "left")
    # a whole file without elements is one piece, "{}" or keys of empty lists
    keyed = keyed.where(~F.col("value").rlike(rf'(?s)^\s*\{{(?:\s*{_EMPTY}\s*,?)*+\s*\}}\s*$'))
    body = F.concat(F.lit("{" + border), F.regexp_extract("value", _ELEMENT, 1))
    row = F.from_json(body, schema, {"mode": "FAILFAST"})
    return keyed.select(F.coalesce("_own", "_carried").alias(key), row.alias("_row")).select(key, "_row.*")
