"""Question-answering benchmark operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Instruction texts and answer vocabulary of the benchmark.
SYSTEM = ("As an expert doctor in clinical science and medical knowledge, can you tell me if the "
          "following statement is correct? Answer yes, no, or maybe.")
USER = "The answer is:"
ALPACA = ("Below is an instruction that describes a task. Write a response that appropriately "
          "completes the request.")
ANSWERS = ["a", "b", "c", "d", "e", "yes", "no"]
DOUBLES = [("yesyes", "yes"), ("nono", "no"), ("yesno", "yes"), ("noyes", "no")]


def qa_prompt(contexts: Column, question: Column) -> Column:
    """Contexts joined by newlines, then the question."""
    return F.concat(F.array_join(contexts, "\n"), F.lit("\n"), question)


def add_instruction(prompt: Column, system: str = SYSTEM, user: str = USER) -> Column:
    """'{system}\\n{prompt}\\n{user}\\n' (F19)."""
    return F.concat(F.lit(system + "\n"), prompt, F.lit("\n" + user + "\n"))


def cot_gold(cot: Column, gold: Column) -> Column:
    return F.concat(cot, F.lit(".\nThe answer is: "), gold, F.lit(" ###"))


def instruction_text(instruction: Column, response: Column) -> Column:
    """Alpaca-style training text."""
    return F.concat(F.lit(ALPACA + "\n### Instruction:\n"), instruction, F.lit("\n### Response: "), response)


def chat_wrap(prompt: Column) -> Column:
    """Question/answer chat markup used at generation."""
    return F.concat(F.lit("<|im_start|>question\n"), prompt, F.lit("<|im_end|>\n<|im_start|>answer\n"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fix_double_answer(c: Column) -> Column:
    """First matching pair of the chain, all its occurrences replaced."""
    out = c
    for pat, rep in reversed(DOUBLES):
        out = F.when(c.contains(pat), F.replace(c, F.lit(pat), F.lit(rep))).otherwise(out)
    return out


def ascii_only(c: Column) -> Column:
    """Drop non-ASCII characters."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def parse_answer(output: Column, answer: Column) -> tuple[Column, Column, Column]:
    """(correct: 1/0 or 2 when unparsable, pred, gold) from lower-cased text."""
    out = F.when(output.contains("\n##"),
                 F.lower(_strip(F.regexp_extract(output, r"\n##([^\n]*)", 1)))).otherwise(output)
    has_marker = answer.contains("###")
    ans_ok = ~has_marker | answer.contains("answer is:")
    ans = F.when(has_marker, _strip(F.regexp_extract(answer, r"(?s)answer is:(.*?)(?:answer is:|###|$)", 1))
                 ).otherwise(answer)
    cleaned = F.regexp_replace(_strip(F.regexp_replace(out, "[^a-zA-Z0-9]", " ")), " +", " ")
    cleaned = ascii_only(fix_double_answer(cleaned))
    ok = ans_ok & cleaned.isin(*ANSWERS)
    correct = F.when(ok, (cleaned == ans).cast("int")).otherwise(F.lit(2))
    return correct, F.when(ok, cleaned).otherwise(output), F.when(ok, ans).otherwise(answer)


def score_generations(gen: DataFrame) -> DataFrame:
    """Add correct / pred / gold_parsed to (prompt, gold, output[, subset]) rows."""
    correct, pred, gold = parse_answer(F.lower("output"), F.lower("gold"))
    return gen.withColumns({"correct": correct, "pred": pred, "gold_parsed": gold})


def accuracy_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy over all rows, correct, counted, unable_to_find_answer, total."""
    g = scored.groupBy(*(by or []))
    return g.agg(
        F.avg((F.col("pred") == F.col("gold_parsed")).cast("double")).alias("accuracy"),
        F.sum(F.when(F.col("correct") == 1, 1).otherwise(0)).cast("long").alias("correct"),
        F.count_if(F.col("correct") != 2).alias("counted"),
        F.count_if(F.col("correct") == 2).alias("unable_to_find_answer"),
        F.count("*").alias("total"))


def ignored_rows(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("correct") == 2)


def attach_generations(rows: DataFrame, generations: DataFrame) -> DataFrame:
    """Every row gets the output of its prompt (J12); joined on (hash, prompt).

    A prompt generated twice counts once, with its smallest output, so that
    rows never multiply.
    """
    g = generations.groupBy("prompt").agg(F.min("output").alias("output")).withColumn("_ph", F.xxhash64("prompt"))
    r = rows.withColumn("_ph", F.xxhash64("prompt"))
    return r.join(g, ["_ph", "prompt"], "left").drop("_ph")
