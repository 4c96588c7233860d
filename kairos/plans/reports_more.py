"""Registered queries: client and pooled views of the train rows, audits, QA texts, file round trips, the round report."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kairos.functions.dates import TEST_GRID, date_text
from kairos.functions.hashing import sql_hash
from kairos.operators import cleaning, cohorts, federated, graph, qa, ranking, sampling, temporal
from kairos.plans import datasets as D
from kairos.plans import evaluation as EV
from kairos.plans import graphs as GP
from kairos.plans import reports_datasets as RD
from kairos.plans import views_sql as V
from kairos.plans.registry import dtxt, register, rnd
from kairos.plans.reports_evaluation import SCORED
from kairos.plans.reports_scoring import _FIT, _QA, _qa_scored
from kairos.plans.reports_temporal import traits
from kairos.session import build_once, checkpoint_dir
from kairos.sources import adapters as A
from kairos.sources import readers, writers

S = D.SEED


def _folder(spark, name):
    """A new folder in the shared space, for queries that write files and read them back."""
    return f"{checkpoint_dir(spark)}/round-trips/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------- train rows

CLIENT = 3


@register("j14_client_rows", V.with_views(f"SELECT * FROM trows WHERE client_id = {CLIENT}", RD.ROWS2))
def j14_client_rows(spark, sf_dir):
    """One client's rows from the written layout: the scan reads that client's folder."""
    path = _folder(spark, "clients")
    writers.write_examples(RD._train_rows(spark, sf_dir), path, "by_client", fmt="parquet")
    schema = "client_id int, example_id string, label boolean"
    rows = readers.read_examples(spark, path, schema, fmt="parquet")
    return GP.client_examples(rows, CLIENT).select("client_id", "example_id", "label")


@register("e3_pooled_train_labels", V.with_views(f"""
    SELECT {dtxt('e.cutoff')} AS cutoff, e.customerID, l.label, string_agg(l.ISIN, ',' ORDER BY l.ISIN) AS assets
    FROM tex e JOIN (SELECT example_id, ISIN, true AS label FROM goodcap
                     UNION ALL SELECT example_id, ISIN, false FROM badpick) l USING (example_id)
    GROUP BY e.example_id, e.cutoff, e.customerID, l.label""", RD.TRAIN))
def e3_pooled_train_labels(spark, sf_dir):
    """The label lists of all clients as one set."""
    rows = RD.e2_train_labels(spark, sf_dir)
    return GP.pooled_train_examples(rows).select("cutoff", "customerID", "label", "assets")


@register("r3_smaller_test_examples", V.with_views(f"""
    SELECT example_id, {dtxt('cutoff')} AS cutoff FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY {sql_hash(f'{S}|small', 'k', 'example_id')}) AS r,
             count(*) OVER (PARTITION BY k) AS n FROM xex) WHERE r <= (n + 9) // 10""", RD.TEST))
def r3_smaller_test_examples(spark, sf_dir):
    """ceil(n/10) examples per cutoff: the 'smaller' evaluation run."""
    lab = D.test_labels(A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir))
    return D.small_sample(lab.examples, 0.1, rounding="ceil").select("example_id", "cutoff")


@register("e4_profitable_assets", V.with_views(f"""
    SELECT {dtxt('cutoff')} AS cutoff, count(*) AS n_assets, md5(string_agg(ISIN, ',' ORDER BY ISIN)) AS members
    FROM ({V.profitable_sql('test_grid')}) GROUP BY cutoff"""))
def e4_profitable_assets(spark, sf_dir):
    """The profitable set that every test example of a cutoff carries, one array per cutoff (bounded by the assets)."""
    prof = temporal.profitable_assets(A.close_prices(spark, sf_dir), TEST_GRID)
    lists = prof.groupBy("cutoff").agg(F.array_sort(F.collect_set("ISIN")).alias("profitableAssets"))
    return lists.select("cutoff", F.size("profitableAssets").cast("long").alias("n_assets"),
                        F.md5(F.array_join("profitableAssets", ",")).alias("members"))


# ------------------------------------------------------------- audits and ids

@register("j1_unknown_customers", V.with_views("""
    SELECT DISTINCT customerID FROM transactions
    WHERE customerID NOT IN (SELECT customerID FROM traits WHERE riskLevel <> (SELECT min(riskLevel) FROM traits))"""))
def j1_unknown_customers(spark, sf_dir):
    """Transaction customers without traits, where the customers of one risk level have been left out of the traits."""
    t = traits(spark, sf_dir)
    lowest = t.agg(F.min("riskLevel").alias("lowest"))
    known = t.join(F.broadcast(lowest), F.col("riskLevel") == F.col("lowest"), "left_anti")
    return cohorts.unknown_customers(A.transactions(spark, sf_dir), known).select("customerID")


@register("f2_iri_ids", V.with_views("SELECT DISTINCT customerID, ISIN FROM transactions"))
def f2_iri_ids(spark, sf_dir):
    """Ids read back from the IRIs that F1 builds."""
    t = A.transactions(spark, sf_dir).select(graph.user_iri(F.col("customerID")).alias("user"),
                                             graph.security_iri(F.col("ISIN")).alias("security")).distinct()
    return t.select(graph.iri_id(F.col("user"), graph.USER_PREFIX).alias("customerID"),
                    graph.iri_id(F.col("security"), graph.ISIN_PREFIX).alias("ISIN"))


# ------------------------------------------------------------- evaluation of the div variant

DIV_ABLATIONS = ["none", "Background"]


@register("a16_div_matrix", V.with_views(f"""
    SELECT ablation, goal_name, count_if(counted) AS n, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
           CAST(sum(fn) AS BIGINT) AS fn FROM a10 WHERE ablation IN ({', '.join(f"'{a}'" for a in DIV_ABLATIONS)})
    GROUP BY ablation, goal_name""", SCORED))
def a16_div_matrix(spark, sf_dir):
    """Goals x the two ablations of the 'div' data."""
    lab = D.test_labels(A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir))
    resp = EV.synthetic_responses(spark, sf_dir, lab, data_variant="div").where(F.col("ablation").isin(*DIV_ABLATIONS))
    rep = ranking.report(EV.scored_responses(resp, lab)).where("level = 'overall'")
    return rep.select("ablation", "goal_name", "n", "tp", "fp", "fn")


# ------------------------------------------------------------- question answering

@register("f20_instruction_texts", V.with_views(f"""
    SELECT doc_id, md5('{qa.ALPACA}' || chr(10) || '### Instruction:' || chr(10) || question || chr(10) || '### Response: ' || gold)
           AS text_md5 FROM qa_rows""", _QA))
def f20_instruction_texts(spark, sf_dir):
    rows = A.qa_rows(spark, sf_dir)
    return rows.select("doc_id", F.md5(qa.instruction_text(F.col("QUESTION"), F.col("final_decision"))).alias("text_md5"))


@register("a25_ignored_rows", V.with_views("SELECT doc_id, pred, gold_parsed FROM qa_final WHERE correct = 2", _QA))
def a25_ignored_rows(spark, sf_dir):
    return qa.ignored_rows(_qa_scored(spark, sf_dir)).select("doc_id", "pred", "gold_parsed")


# ------------------------------------------------------------- federated rounds

@register("e12_round_report", V.with_views(f"""
    SELECT f.round, f.train_loss, v.n_values, v.value_sum, f.n_clients, f.num_examples
    FROM (SELECT round, {rnd('sum(num_examples * train_loss) / sum(num_examples)')} AS train_loss,
                 count(DISTINCT client_id) AS n_clients, CAST(sum(num_examples) AS BIGINT) AS num_examples FROM fit GROUP BY round) f
    JOIN (SELECT round, count(*) AS n_values, {rnd('sum(value)')} AS value_sum FROM (
            SELECT round, pos, sum(num_examples * CAST(v AS DOUBLE)) / sum(num_examples) AS value
            FROM (SELECT round, num_examples, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM fit)
            GROUP BY ALL) GROUP BY round) v USING (round)""", _FIT))
def e12_round_report(spark, sf_dir):
    return federated.round_report(A.fit_metrics(spark, sf_dir), A.parameter_vectors(spark, sf_dir))


# ------------------------------------------------------------- files written and read back

@register("s5_examples_by_date", V.with_views(f"SELECT {dtxt('cutoff')} AS cutoff, example_id, customerID FROM xex", RD.TEST))
def s5_examples_by_date(spark, sf_dir):
    """Examples as JSON, one folder per cutoff, sorted within the files, read back with the declared schema."""
    lab = D.test_labels(A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir))
    path = _folder(spark, "examples")
    rows = lab.examples.select(date_text(F.col("cutoff")).alias("cutoff"), "example_id", "customerID")
    writers.write_examples(rows.sortWithinPartitions("cutoff", "customerID"), path, "by_date")
    return readers.read_examples(spark, path, "cutoff string, example_id string, customerID string").select(
        "cutoff", "example_id", "customerID")


_USER, _ASSISTANT = "Ranked assets {\"at\": ", "}], \"prompt\": "


@register("s6_nested_examples", V.with_views(f"""
    SELECT {dtxt('cutoff')} AS cutoff, example_id, 2 AS n_turns, 'user' AS last_role, '{_USER}' || {dtxt('cutoff')} AS content,
           '{_ASSISTANT}' || customerID AS completion
    FROM xex""", RD.TEST))
def s6_nested_examples(spark, sf_dir):
    """Examples with nested turns as JSON objects keyed by cutoff, read back piece by piece."""
    lab = D.test_labels(A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir))
    path = _folder(spark, "nested")

    def turn(role, *content):
        return F.struct(F.lit(role).alias("role"), F.concat(*content).alias("content"))
    day = date_text(F.col("cutoff"))
    rows = lab.examples.select(
        day.alias("cutoff"), F.array(turn("system", F.lit("")), turn("user", F.lit(_USER), day)).alias("prompt"),
        F.array(turn("assistant", F.lit(_ASSISTANT), F.col("customerID"))).alias("completion"), "example_id")
    writers.write_keyed_json(rows, path, "cutoff", "example_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    turns = "array<struct<role: string, content: string>>"
    back = readers.read_keyed_json(spark, path, f"prompt {turns}, completion {turns}, example_id string", "prompt", "cutoff")
    return back.select("cutoff", "example_id", F.size("prompt").alias("n_turns"), F.col("prompt")[1]["role"].alias("last_role"),
                       F.col("prompt")[1]["content"].alias("content"), F.col("completion")[0]["content"].alias("completion"))


@register("s7_materialized_prices", V.with_views("""
    SELECT ISIN, count(*) AS n FROM close_prices GROUP BY ISIN"""))
def s7_materialized_prices(spark, sf_dir):
    """Built at the first call, only read at the second."""
    path = _folder(spark, "prices")
    for _ in range(2):
        prices = writers.materialize_or_load(spark, path, lambda: A.close_prices(spark, sf_dir))
    return prices.groupBy("ISIN").agg(F.count("*").alias("n"))


@register("s7_build_once", V.with_views("""
    SELECT ISIN, count(*) AS n, true AS same_inputs_reused, true AS new_inputs_rebuilt FROM close_prices GROUP BY ISIN"""))
def s7_build_once(spark, sf_dir):
    """Prices from a copy of the tables: a second build finds the first's table, one after a changed input makes its own."""
    folder = _folder(spark, "inputs")
    line = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    line.write.parquet(f"{folder}/lineitem.parquet")
    build = lambda: build_once(A.close_prices(spark, folder), "prices")
    first, second = build().inputFiles(), build().inputFiles()
    line.limit(0).write.mode("append").parquet(f"{folder}/lineitem.parquet")  # one more file, without rows
    third = build()
    return third.groupBy("ISIN").agg(F.count("*").alias("n")).withColumns({
        "same_inputs_reused": F.lit(sorted(first) == sorted(second)), "new_inputs_rebuilt": F.lit(not set(first) & set(third.inputFiles()))})


@register("s8_stored_responses", V.with_views("SELECT ablation, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM resp GROUP BY ablation", SCORED))
def s8_stored_responses(spark, sf_dir):
    lab = D.test_labels(A.transactions(spark, sf_dir), A.close_prices(spark, sf_dir))
    path = _folder(spark, "responses")
    writers.write_responses(EV.synthetic_responses(spark, sf_dir, lab), path)
    back = readers.read_responses(spark, path)
    return back.groupBy("ablation").agg(F.count("*").alias("n"), F.sum("n_tokens").cast("long").alias("n_tokens"))


_EVENTS = "conv_id long, turn long, role string, text string"


def _conversation_files(spark, sf_dir):
    path = _folder(spark, "conversations")
    writers.write_jsonl(A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return path


_CONV = "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations"


def _conv(df):
    return df.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@register("s9_jsonl_tolerant", V.with_views(_CONV + " UNION ALL SELECT -1, 1, 'malformed', NULL"))
def s9_jsonl_tolerant(spark, sf_dir):
    """Good rows, and one row that counts the malformed lines (one is added)."""
    path = _conversation_files(spark, sf_dir)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    good, bad = readers.read_jsonl_tolerant(spark, path, spark.createDataFrame([], _EVENTS).schema)
    count = bad.agg(F.count("*").alias("turn")).select(F.lit(-1).cast("long").alias("conv_id"), "turn", F.lit("malformed").alias("role"),
                                                       F.lit(None).cast("string").alias("text_md5"))
    return _conv(good).unionByName(count)


@register("s10_jsonl_strict", V.with_views(_CONV))
def s10_jsonl_strict(spark, sf_dir):
    return _conv(readers.read_jsonl(spark, _conversation_files(spark, sf_dir), spark.createDataFrame([], _EVENTS).schema))


@register("s11_jsonl_shuffled", V.with_views(f"""
    SELECT conv_id, turn, role, md5(text) AS text_md5, row_number() OVER (ORDER BY {sql_hash(7, "concat(conv_id, '|', turn)")}) - 1 AS place
    FROM conversations"""))
def s11_jsonl_shuffled(spark, sf_dir):
    """All conversations' lines in a seeded order, each with its place in it."""
    rows = readers.read_jsonl(spark, _conversation_files(spark, sf_dir), spark.createDataFrame([], _EVENTS).schema)
    rows = sampling.seeded_shuffle(rows.withColumn("key", F.concat_ws("|", "conv_id", "turn")), 7, "key", "place")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "place")


@register("s12_scores_csv", V.with_views("SELECT vec_id, CAST(label AS INTEGER) AS label FROM embeddings WHERE label IS NOT NULL"))
def s12_scores_csv(spark, sf_dir):
    path = _folder(spark, "scores")
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"),
                                                    F.concat(F.lit("a, b "), F.col("vec_id")).alias("text"))
    e.write.option("header", "true").option("quote", "|").csv(path)
    return readers.read_scores_csv(spark, path, e.schema).select("vec_id", "label")


@register("s13_read_subsets", V.with_views("SELECT doc_id, lang AS subset FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')"))
def s13_read_subsets(spark, sf_dir):
    """One folder per language, read as subsets and united."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang")
    paths = {}
    for lang in ("en", "de", "fr", "es"):
        paths[lang] = _folder(spark, f"subset-{lang}")
        d.where(F.col("lang") == lang).select("doc_id").write.parquet(paths[lang])
    return readers.read_subsets(spark, paths).select("doc_id", "subset")


@register("s14_saved_split", V.with_views(f"""
    SELECT client_id, example_id, label, row_number() OVER (PARTITION BY client_id
           ORDER BY {sql_hash(1234, 'client_id', 'example_id', 'label')}) <= ceil(count(*) OVER (PARTITION BY client_id) * 0.1) AS in_test
    FROM trows""", RD.ROWS2))
def s14_saved_split(spark, sf_dir):
    train, test = sampling.train_test_split(RD._train_rows(spark, sf_dir), "client_id", 1234, ["example_id", "label"], 0.1)
    a, b = _folder(spark, "train"), _folder(spark, "test")
    writers.save_split(train, a)
    writers.save_split(test, b)
    train, test = readers.read_split(spark, a, b)
    return train.withColumn("in_test", F.lit(False)).unionByName(test.withColumn("in_test", F.lit(True))).select(
        "client_id", "example_id", "label", "in_test")


@register("p6_instruction_columns", V.with_views("SELECT doc_id, question AS instruction, gold AS response FROM qa_rows", _QA))
def p6_instruction_columns(spark, sf_dir):
    rows = A.qa_rows(spark, sf_dir).select("doc_id", F.lit("x").alias("instruction"), F.col("QUESTION").alias("input"),
                                           F.col("final_decision").alias("output"))
    return cleaning.format_instruction_dataset(rows)


@register("p7_flattened", V.with_views("SELECT doc_id, gold AS \"answer.decision\", md5(long_answer) AS \"answer.long_md5\" FROM qa_rows", _QA))
def p7_flattened(spark, sf_dir):
    nested = A.qa_rows(spark, sf_dir).select("doc_id", F.struct(F.col("final_decision").alias("decision"),
                                                               F.md5("LONG_ANSWER").alias("long_md5")).alias("answer"))
    return cleaning.flatten(nested)
