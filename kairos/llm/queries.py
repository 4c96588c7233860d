"""The registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.llm import bpe, divergence, interaction, lattice, licenses, mixing, nearest, pii, simhash, substrings, topk, toxicity, urls
from kairos.llm import oracles as O
from kairos.llm.common import table


@dataclass
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = Query(fn, sql)
        return fn
    return deco


@register("op5_pii", O.PII)
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    base = [k.name for k in pii.KINDS if k.base]
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text([k.name for k in pii.KINDS]).alias("spans"))


def word_bpe_spec(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public vocabulary with word ends."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


@register("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), word_bpe_spec(), with_ids=False)


@register("op1_licenses", O.LICENSES)
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    labels = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["label"])))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda m: m["label"]))), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), licenses.score(labels).alias("score"))


@register("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_mixing", O.MIXING)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


@register("op9_substrings")
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), with_text=False)


@register("op2_urls", O.URLS)
def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@register("op3_topk", O.TOPK)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


@register("op7_nearest")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


@register("op13_filter_audit", O.FILTER_AUDIT)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op11_source_divergence", O.SOURCE_DIVERGENCE)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@register("op12_lattice")
def op12_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.dedup(table(spark, sf_dir, "embeddings"))
