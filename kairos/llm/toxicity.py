"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of three lexicons (a fixed one of insults, one of words
and one of word beginnings learned from the labels), how close lexicon words
stand to second-person words, second-person density, capitals, punctuation
and obfuscation rates, and length. Label, language, source and id are no
features.

Learning uses only rows whose crc32(doc_id as text) mod 5 is not 0, and at
most about ``MAX_TRAIN`` of them, drawn by a hash of the id (all, if fewer);
that bounds the lexicon, the trees and the calibration, while scoring covers
every text. A learned word needs a likelihood ratio that chance does not
reach, so that words of a few toxic texts alone do not enter. Trees are
fitted on one part of the rows and calibrated on the rest.

Defined cases: a null text counts as empty and is scored like any other; a
null doc_id is never held out nor learned from; repeated rows give repeated
results; an id labelled twice is toxic if any label says so; without both
labels every score is the share of toxic labels (0 without labels); columns
besides doc_id and text are ignored by ``score`` and kept by ``reject``; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import materialize, pick

HELD_OUT = 5          # every fifth remainder is never learned from
MAX_TRAIN = 20_000    # labelled rows that are learned from, about
MAX_LEXICON = 4_000   # learned entries kept, by likelihood ratio
MAX_COUNTED = 50_000  # entries counted in memory before they are passed on
MIN_DOCS, MIN_RATIO = 4, 25.0
BEGINNINGS = (5, 6)   # lengths of the word beginnings
TREES, DEPTH, STEP = 20, 3, 0.2
NEAR = 8              # words between a lexicon word and a second-person word

# Common insults, and second-person words of four languages.
INSULTS = frozenset("""
ass asshole bastard bitch clown crap creep cretin damn degenerate dimwit disgusting dumb dumbass fool filth garbage
idiot idiotic imbecile inferior jerk kill loser losers moron moronic pathetic pig scum scumbag shit shut stupid sucker
trash ugly useless vermin vile worthless abschaum arschloch dumm dummkopf idioten schwein trottel versager widerlich
abruti connard crétin débile imbécile ordure salaud basura escoria estúpido idiota imbécil inútil asqueroso
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros vuestro
""".split())
LEET = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W\d_]+")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
MARK = re.compile(r"[^\w\s]")
LOUD = re.compile(r"[!?]")
MIXED = re.compile(r"[a-zA-Z]+[0-9@$*!#]+[a-zA-Z]+")
STRETCHED = re.compile(r"([a-zA-Z])\1{2,}")

FEATURES = ("insults", "insult_words", "learned", "learned_words", "beginnings", "beginning_words", "near_second_person",
            "second_person", "capitals", "shouting", "marks", "loud_marks", "obfuscated", "hidden_insults", "stretched", "length")


def features(text: str | None, words: frozenset, beginnings: frozenset) -> list[float]:
    text = text or ""
    low = WORD.findall(text.lower())
    n, chars = max(1, len(low)), max(1, len(text))
    insults = [i for i, w in enumerate(low) if w in INSULTS]
    learned = [i for i, w in enumerate(low) if w in words]
    begun = sum([1 for w in low if len(w) > BEGINNINGS[0] and any(w[:k] in beginnings for k in BEGINNINGS if len(w) > k)]) \
        if beginnings else 0
    second = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near = 0.0
    if second:
        j = 0
        for i in sorted({*insults, *learned}):
            while j + 1 < len(second) and abs(second[j + 1] - i) <= abs(second[j] - i):
                j += 1
            gap = abs(second[j] - i)
            near += 1 / (1 + gap) if gap <= NEAR else 0.0
    mixed = MIXED.findall(text)
    hidden = sum([1 for w in mixed if w.lower().translate(LEET) in INSULTS])
    return [len(insults) / n, math.log1p(len(insults)), len(learned) / n, math.log1p(len(learned)), begun / n, math.log1p(begun),
            near / n, len(second) / n, len(CAPITAL.findall(text)) / chars, len(SHOUT.findall(text)) / n,
            len(MARK.findall(text)) / chars, len(LOUD.findall(text)) / chars, len(mixed) / n, float(hidden),
            len(STRETCHED.findall(text)) / n, math.log1p(len(low))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``toxic`` of the labels to learn from: never held out, about ``MAX_TRAIN`` at most."""
    own = (pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = MAX_TRAIN / max(1, own.count())
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return own


def ratio(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Likelihood ratio of an entry's counts against the same share of toxic texts everywhere; 0 for entries of clean texts."""
    n, p = toxic + clean, all_toxic / (all_toxic + all_clean)
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    return F.when(toxic > n * p, 2 * (part(toxic, p) + part(clean, 1 - p))).otherwise(0.0)


def learn_lexicon(train: DataFrame, all_toxic: int, all_clean: int) -> tuple[frozenset, frozenset]:
    """Words and word beginnings of ``train`` (``text``, ``toxic``) that toxic texts have far more often."""
    def frame(seen):
        entries = [*(seen[0] | seen[1])]
        return pd.DataFrame({"entry": entries, "toxic": [seen[1][e] for e in entries], "clean": [seen[0][e] for e in entries]}
                            ).astype({"toxic": "int64", "clean": "int64"})

    def count(batches):
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(b["text"], b["toxic"]):
                words = set(WORD.findall((text or "").lower()))
                seen[int(toxic)].update(words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k})
                if len(seen[0]) + len(seen[1]) > MAX_COUNTED:
                    yield frame(seen)
                    seen = (Counter(), Counter())
            yield frame(seen)
    counts = train.mapInPandas(count, "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = (counts.where(f"toxic >= {MIN_DOCS}")
            .withColumn("ratio", ratio(F.col("toxic"), F.col("clean"), all_toxic, all_clean))
            .where(f"ratio >= {MIN_RATIO}").orderBy(F.desc("ratio"), "entry").limit(MAX_LEXICON))
    entries = [r["entry"] for r in best.select("entry").collect()]
    return frozenset(e for e in entries if not e.endswith("*")), frozenset(e[:-1] for e in entries if e.endswith("*"))


@dataclass
class Model:
    """What is learned: lexicons, trees and calibration, or a constant share if there was one label only."""

    words: frozenset
    beginnings: frozenset
    share: float
    trees: object = None
    calibration: object = None

    def features(self, text: Column) -> Column:
        words, beginnings = self.words, self.beginnings

        @F.pandas_udf("array<double>")
        def of(texts: pd.Series) -> pd.Series:
            return pd.Series([features(t, words, beginnings) for t in texts])
        return of(text)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` (with an array column ``tox_features``) and ``tox_score``."""
        if self.trees is None:
            return df.withColumn("tox_score", F.lit(float(self.share)))
        df = self.trees.transform(df.withColumn("tox_vector", array_to_vector("tox_features")))
        df = df.withColumn("tox_raw", vector_to_array("tox_probability")[1])
        df = self.calibration.transform(df)
        # the steps of the calibration, with the trees' order kept within a step
        return df.withColumn("tox_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("tox_step") + 0.01 * F.col("tox_raw"))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    own = training_labels(labels)
    # the learned rows are bounded by MAX_TRAIN, so their ids and labels may be broadcast
    train = materialize(pick(docs, "doc_id", "text").join(F.broadcast(own), "doc_id"), "train")
    counts = dict(train.groupBy("toxic").count().collect())
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Model(frozenset(), frozenset(), toxic / max(1, toxic + clean))
    model = Model(*learn_lexicon(train, toxic, clean), toxic / (toxic + clean))
    rows = materialize(train.select(
        (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0).alias("calibrate"),
        F.col("toxic").cast("double").alias("toxic"), model.features(F.col("text")).alias("tox_features")), "features").coalesce(6)
    rows = rows.withColumn("tox_vector", array_to_vector("tox_features"))
    parts = {r["calibrate"]: r["n"] for r in rows.groupBy("calibrate").agg(F.countDistinct("toxic").alias("n")).collect()}
    both = parts.get(True, 0) == 2 and parts.get(False, 0) == 2  # too few rows to part: learn from all of them twice
    learn, check = (rows.where("NOT calibrate"), rows.where("calibrate")) if both else (rows, rows)
    booster = GBTClassifier(featuresCol="tox_vector", labelCol="toxic", predictionCol="tox_class", maxIter=TREES,
                            maxDepth=DEPTH, stepSize=STEP, seed=7, minInstancesPerNode=4)
    trees = booster.setRawPredictionCol("tox_margin").setProbabilityCol("tox_probability").fit(learn)
    raw = trees.transform(check).select("toxic", vector_to_array("tox_probability")[1].alias("tox_raw"))
    model.trees = trees
    model.calibration = IsotonicRegression(featuresCol="tox_raw", labelCol="toxic", predictionCol="tox_step").fit(raw)
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every row."""
    model = fit(docs, labels)
    d = pick(docs, "doc_id", "text").select("doc_id", model.features(F.col("text")).alias("tox_features"))
    return model.apply(d).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"),
                                 (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, columns as they are."""
    model = fit(docs, labels)
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index('text')}")
    return (model.apply(flat.withColumn("tox_features", model.features(text))).where("tox_score < 0.5")
            .select(flat.columns).toDF(*docs.columns))
