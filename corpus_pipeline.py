"""A training corpus from raw documents: filter, deduplicate, redact, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. ``run`` writes each stage's result as
Parquet into the shared folder and gives the reread table to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairos.llm import bpe, mixing, pii, simhash, toxicity
from kairos.llm.common import materialize, table
from kairos.llm.queries import word_bpe_spec


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal fingerprints: the smallest doc_id."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text replaced by its kind; ``n_chars`` follows."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixing plan takes them (a small leaf repeats over epochs)."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids, their number, and digests of ids and decoded text."""
    return bpe.encode(docs, word_bpe_spec())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("pii", redact_personal_data), ("mixing", mix_sources),
          ("bpe", tokenize)]

# The classifier, XXH64 and the components can't be written in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
