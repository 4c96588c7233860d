"""Registered queries: membership inference, QA benchmark and federated aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos.functions.hashing import sql_hash
from kairos.operators import federated, membership, qa
from kairos.plans import views_sql as V
from kairos.plans.registry import register, rnd
from kairos.sources import adapters as A

# ---------------------------------------------------------------- membership

def _sum_lp(start, length, scale):
    return (f"list_reduce(list_transform(embedding[{start}:{start + length - 1}], "
            f"lambda x: CAST(-abs(x) AS DOUBLE) * CAST({scale} AS DOUBLE)), lambda a, x: a + x, CAST(0.0 AS DOUBLE))")


def _ppl(start, length, scale):
    return f"exp(-({_sum_lp(start, length, scale)}) / {length})"


_MIA = {
    "mia_in": f"""SELECT vec_id AS text_id, 'vector ' || CAST(vec_id AS VARCHAR) AS text,
                         CAST(label % 2 AS DOUBLE) AS label,
                         {_ppl(1, 64, 1.0)} AS ppl_pre, {_ppl(2, 63, 0.9)} AS ppl_fl, {_ppl(3, 62, 0.8)} AS ppl_cen,
                         {_ppl(1, 60, 0.95)} AS ppl_fl_lower, {_ppl(5, 60, 0.85)} AS ppl_cen_lower
                  FROM embeddings""",
    "mia_scores": """SELECT text_id, text, label, ppl_pre / ppl_fl AS pre_to_fl_score, ppl_pre / ppl_cen AS pre_to_cen_score,
                            CASE WHEN ln(ppl_fl_lower) = 0 THEN NULL ELSE ln(ppl_fl) / ln(ppl_fl_lower) END AS fl_log_lower_score,
                            CASE WHEN ln(ppl_cen_lower) = 0 THEN NULL ELSE ln(ppl_cen) / ln(ppl_cen_lower) END AS cen_log_lower_score
                     FROM mia_in""",
    "mia_long": """SELECT * FROM (UNPIVOT mia_scores ON pre_to_fl_score, pre_to_cen_score, fl_log_lower_score,
                                   cen_log_lower_score INTO NAME metric VALUE score)
                   WHERE score IS NOT NULL AND NOT isnan(score)""",
    "mia_pts": """SELECT metric, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                         sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM mia_long GROUP BY ALL""",
    "mia_cum": """SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
                         sum(pos) OVER (PARTITION BY metric) AS P, sum(neg) OVER (PARTITION BY metric) AS N,
                         row_number() OVER w = 1 OR lead(pos) OVER w IS NULL OR lead(pos) OVER w <> pos OR lead(neg) OVER w <> neg AS corner
                  FROM mia_pts WINDOW w AS (PARTITION BY metric ORDER BY score DESC
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}


def _mia_scores(spark, sf_dir):
    s = membership.scores(A.membership_input(spark, sf_dir))
    return s.select("text_id", "text", "label", *membership.SCORE_COLUMNS)


def _mia_long(spark, sf_dir):
    s = _mia_scores(spark, sf_dir)
    return membership.long_scores(s, ["text_id"], membership.metric_columns(s.columns))


@register("e8_membership_eval_data", V.with_views(f"""
    SELECT *, row_number() OVER (ORDER BY {sql_hash(42, 'text_id')}) - 1 AS place FROM (
      SELECT vec_id AS text_id, 'member ' || CAST(vec_id AS VARCHAR) AS text, 1.0 AS label FROM embeddings WHERE label % 2 = 1
      UNION ALL
      SELECT vec_id, 'nonmember ' || CAST(vec_id AS VARCHAR), 0.0 FROM embeddings WHERE label % 2 = 0)"""))
def e8_membership_eval_data(spark, sf_dir):
    from kairos.operators import sampling
    e = A.table(spark, sf_dir, "embeddings")
    pos = e.where(F.col("label") % 2 == 1).select(
        F.col("vec_id").alias("text_id"), F.concat(F.lit("member "), F.col("vec_id").cast("string")).alias("text"))
    neg = e.where(F.col("label") % 2 == 0).select(
        F.col("vec_id").alias("text_id"),
        F.array(F.concat(F.lit("nonmember "), F.col("vec_id").cast("string")), F.lit("context")).alias("input"))
    pos = pos.withColumn("label", F.lit(1.0))                                   # P8
    neg = neg.withColumn("label", F.lit(0.0)).select("text_id", F.get("input", 0).alias("text"), "label")  # P9
    return sampling.seeded_shuffle(pos.unionByName(neg), 42, "text_id", "place")       # U1, R5


@register("a20_perplexity", V.with_views("""
    SELECT text_id, round(ppl_pre, 6) AS ppl_pre, round(ppl_fl, 6) AS ppl_fl, round(ppl_cen, 6) AS ppl_cen
    FROM mia_in""", _MIA))
def a20_perplexity(spark, sf_dir):
    m = A.membership_input(spark, sf_dir)
    return m.select("text_id", membership.perplexity(F.col("lp_pre")).alias("ppl_pre"),
                    membership.perplexity(F.col("lp_fl")).alias("ppl_fl"),
                    membership.perplexity(F.col("lp_cen")).alias("ppl_cen"))


@register("f15_membership_scores", V.with_views(f"""
    SELECT text_id, label, {rnd('pre_to_fl_score')} AS pre_to_fl_score, {rnd('pre_to_cen_score')} AS pre_to_cen_score,
           {rnd('fl_log_lower_score')} AS fl_log_lower_score, {rnd('cen_log_lower_score')} AS cen_log_lower_score
    FROM mia_scores""", _MIA))
def f15_membership_scores(spark, sf_dir):
    return _mia_scores(spark, sf_dir).drop("text")


@register("a21_roc_curve", V.with_views(f"""
    SELECT metric, {rnd('score')} AS score, {rnd('cp / P')} AS tpr, {rnd('cn / N')} AS fpr, corner FROM mia_cum""", _MIA))
def a21_roc_curve(spark, sf_dir):
    return membership.roc_curve(_mia_long(spark, sf_dir)).select("metric", "score", "tpr", "fpr", "corner")


@register("e9_membership_report", V.with_views(f"""
    SELECT metric, {rnd('sum(neg * (2 * cp - pos)) / (2.0 * max(P) * max(N))')} AS auc,
           {rnd('greatest(max(1 - (cn / N + 1 - cp / P) / 2), 0.5)')} AS balanced_accuracy,
           {rnd('greatest(coalesce(max(CASE WHEN cn / N < 0.05 AND corner THEN cp / P END), 0.0), 0.0)')} AS tpr_at_low_fpr,
           max(P) AS n_pos, max(N) AS n_neg
    FROM mia_cum GROUP BY metric""", _MIA))
def e9_membership_report(spark, sf_dir):
    return membership.roc_summary(membership.roc_curve(_mia_long(spark, sf_dir)))


@register("e10_membership_test", V.with_views("""
    SELECT text_id, round(ppl_fl / ppl_pre, 6) AS ratio, ppl_fl / ppl_pre < 1 AS membership,
           printf('Normalised Perplexity: %.2f -->  Membership: %s', ppl_fl / ppl_pre,
                  CASE WHEN ppl_fl / ppl_pre < 1 THEN 'True' ELSE 'False' END) AS message
    FROM mia_in""", _MIA))
def e10_membership_test(spark, sf_dir):
    m = membership.membership_flags(A.membership_input(spark, sf_dir), "lp_fl", "lp_pre")
    return m.select("text_id", "ratio", "membership", "message")


# ------------------------------------------------------------------------ QA

_QA = {
    "qa_rows": f"""SELECT d.doc_id, d.text, d.lang AS subset,
                          'Is document ' || CAST(d.doc_id AS VARCHAR) || ' of good quality?' AS question,
                          CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS gold,
                          'The document is ' || CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'not toxic' END || '.' AS long_answer
                   FROM documents d JOIN labels l USING (doc_id)""",
    "qa_prompts": f"""SELECT doc_id, subset, gold, long_answer,
                             '{qa.SYSTEM}' || chr(10) || text || chr(10) || question || chr(10) || '{qa.USER}' || chr(10) AS prompt
                      FROM qa_rows""",
    "qa_gen": f"""SELECT *, ['yes', 'no', 'yesyes', 'yesno', chr(10) || '## yes', 'unclear'][
                    CAST(('0x' || substr({sql_hash(2025, 'prompt')}, 1, 8))::BIGINT % 6 AS INTEGER) + 1] AS output
                  FROM qa_prompts""",
    "qa_p1": """SELECT *, lower(output) AS o, lower(gold) AS a FROM qa_gen""",
    "qa_p2": """SELECT *, CASE WHEN contains(o, chr(10) || '##')
                          THEN lower(regexp_replace(regexp_extract(o, '\\n##([^\\n]*)', 1), '^\\s+|\\s+$', '', 'g'))
                          ELSE o END AS o2,
                     NOT contains(a, '###') OR contains(a, 'answer is:') AS ans_ok,
                     CASE WHEN contains(a, '###') THEN regexp_replace(regexp_extract(a,
                          '(?s)answer is:(.*?)(?:answer is:|###|$)', 1), '^\\s+|\\s+$', '', 'g') ELSE a END AS a2
              FROM qa_p1""",
    "qa_p3": """SELECT *, regexp_replace(regexp_replace(regexp_replace(o2, '[^a-zA-Z0-9]', ' ', 'g'),
                                                    '^\\s+|\\s+$', '', 'g'), ' +', ' ', 'g') AS c0 FROM qa_p2""",
    "qa_p4": """SELECT *, CASE WHEN contains(c0, 'yesyes') THEN replace(c0, 'yesyes', 'yes')
                               WHEN contains(c0, 'nono') THEN replace(c0, 'nono', 'no')
                               WHEN contains(c0, 'yesno') THEN replace(c0, 'yesno', 'yes')
                               WHEN contains(c0, 'noyes') THEN replace(c0, 'noyes', 'no') ELSE c0 END AS c1 FROM qa_p3""",
    "qa_scored": """SELECT *, ans_ok AND c1 IN ('a', 'b', 'c', 'd', 'e', 'yes', 'no') AS ok FROM qa_p4""",
    "qa_final": """SELECT doc_id, subset, CASE WHEN ok THEN CAST(c1 = a2 AS INTEGER) ELSE 2 END AS correct,
                          CASE WHEN ok THEN c1 ELSE o END AS pred, CASE WHEN ok THEN a2 ELSE a END AS gold_parsed
                   FROM qa_scored""",
}


def _qa_scored(spark, sf_dir):
    rows = A.qa_rows(spark, sf_dir)
    p = rows.select("doc_id", "subset", F.col("final_decision").alias("gold"),
                    F.col("LONG_ANSWER").alias("long_answer"),
                    qa.add_instruction(qa.qa_prompt(F.col("CONTEXTS"), F.col("QUESTION"))).alias("prompt"))
    with_out = qa.attach_generations(p, A.qa_generations(p))
    return qa.score_generations(with_out)


@register("s13_qa_subsets", V.with_views("""
    SELECT doc_id, subset, gold, long_answer, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars
    FROM qa_prompts""", _QA))
def s13_qa_subsets(spark, sf_dir):
    rows = A.qa_rows(spark, sf_dir)
    prompt = qa.add_instruction(qa.qa_prompt(F.col("CONTEXTS"), F.col("QUESTION")))
    return rows.select("doc_id", "subset", F.col("final_decision").alias("gold"),
                       F.col("LONG_ANSWER").alias("long_answer"), F.md5(prompt).alias("prompt_md5"),
                       F.length(prompt).cast("long").alias("prompt_chars"))


@register("f22_answer_parse", V.with_views("SELECT * FROM qa_final", _QA))
def f22_answer_parse(spark, sf_dir):
    return _qa_scored(spark, sf_dir).select("doc_id", "subset", "correct", "pred", "gold_parsed")


@register("e11_qa_report", V.with_views(f"""
    SELECT subset, {rnd('avg(CAST(pred = gold_parsed AS DOUBLE))')} AS accuracy,
           CAST(sum(CASE WHEN correct = 1 THEN 1 ELSE 0 END) AS BIGINT) AS correct,
           count_if(correct <> 2) AS counted, count_if(correct = 2) AS unable_to_find_answer, count(*) AS total
    FROM qa_final GROUP BY subset""", _QA))
def e11_qa_report(spark, sf_dir):
    return qa.accuracy_summary(_qa_scored(spark, sf_dir), ["subset"])


@register("e11_qa_report_overall", V.with_views(f"""
    SELECT {rnd('avg(CAST(pred = gold_parsed AS DOUBLE))')} AS accuracy,
           CAST(sum(CASE WHEN correct = 1 THEN 1 ELSE 0 END) AS BIGINT) AS correct,
           count_if(correct <> 2) AS counted, count_if(correct = 2) AS unable_to_find_answer, count(*) AS total
    FROM qa_final""", _QA))
def e11_qa_report_overall(spark, sf_dir):
    return qa.accuracy_summary(_qa_scored(spark, sf_dir))


# ----------------------------------------------------------------- federated

_FIT = {"fit": """SELECT CAST(1 + vec_id % 5 AS INTEGER) AS round, CAST(label AS INTEGER) AS client_id,
                         CAST(1 + vec_id % 7 AS BIGINT) AS num_examples,
                         list_reduce(embedding, lambda a, x: a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE), CAST(0.0 AS DOUBLE)) AS train_loss,
                         embedding FROM embeddings"""}


@register("a17_weighted_loss", V.with_views(f"""
    SELECT round, {rnd('sum(num_examples * train_loss) / sum(num_examples)')} AS train_loss
    FROM fit GROUP BY round""", _FIT))
def a17_weighted_loss(spark, sf_dir):
    return federated.weighted_loss(A.fit_metrics(spark, sf_dir))


@register("a18_weighted_vectors", V.with_views(f"""
    SELECT round, 'adapter' AS param, CAST(pos - 1 AS INTEGER) AS pos,
           {rnd('sum(num_examples * CAST(v AS DOUBLE)) / sum(num_examples)')} AS value
    FROM (SELECT round, num_examples, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM fit)
    GROUP BY ALL""", _FIT))
def a18_weighted_vectors(spark, sf_dir):
    return federated.weighted_vectors_long(A.parameter_vectors(spark, sf_dir))


@register("f21_chat_wrapped_prompts", V.with_views("""
    SELECT doc_id, md5('<|im_start|>question' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>answer' || chr(10))
           AS wrapped_md5 FROM qa_prompts""", _QA))
def f21_chat_wrapped_prompts(spark, sf_dir):
    rows = A.qa_rows(spark, sf_dir)
    prompt = qa.add_instruction(qa.qa_prompt(F.col("CONTEXTS"), F.col("QUESTION")))
    return rows.select("doc_id", F.md5(qa.chat_wrap(prompt)).alias("wrapped_md5"))
