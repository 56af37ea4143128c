"""Quality by weak labels: heuristic labellers vote, expectation maximisation estimates how far to trust each, and the
posterior labels train a hashed linear scorer.

Votes are 1, 0 or none, so there are at most ``3 ** labellers`` patterns; all documents are counted by pattern, and the
estimation runs over the patterns on the driver. The scorer is a logistic regression over hashed words and signs,
fitted on about ``TRAINING_ROWS`` documents chosen by a hash of id and text (all, where there are fewer), each with the posterior
of its pattern as a soft label. It then scores every document.

Defined results: null and empty texts have no words and score as the scorer's intercept says; repeated rows are scored one
by one, and rows alike in id and text count once in the fit; with no rows, no vote at all, or none of the rows chosen
for the fit, as may be where all are alike, every score is 0.5; other columns of the input play no part. Texts have no
length limit.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_words

TRAINING_ROWS = 20_000
TRAINING_TASKS = 12
FEATURES = 1 << 15
ROUNDS = 100
LEAST_SCORE = 0.5
# Frequent function words of four languages.
FUNCTION_WORDS = (
    "a an and as at be by for from in is it of on or that the this to was with das dem den der des die ein eine ist mit "
    "nicht und von zu au dans de des du et la le les pour que un une con del el en los las no para por se y").split()


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit("0")).when(good, F.lit("1")).otherwise(F.lit("-"))


def with_votes(docs: DataFrame) -> DataFrame:
    """The columns of the input, ``words``, and ``pattern``, one character for each labeller: 1, 0 or - for no vote."""
    text = F.coalesce("text", F.lit(""))
    step = docs.withColumn("words", split_words(F.col("text")))
    marks = F.regexp_replace(text, r"[\p{L}\p{N}\s]+", " ")
    twice = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: a == b)
    function_words = F.filter("words", lambda word: F.lower(word).isin(FUNCTION_WORDS))
    step = step.withColumns({
        "_marks": marks, "_n": F.size("words"), "_twice": F.size(F.filter(twice, lambda same: same)),
        "_unlike": F.size(F.array_distinct("words")), "_function": F.size(function_words),
        "_capitals": F.regexp_count(text, F.lit(r"[A-Z]{3,}")), "_size": F.char_length(text)})
    n = F.col("_n")
    bars = F.regexp_count("_marks", F.lit(r"[\x7C]"))
    runs = F.regexp_count("_marks", F.lit(r"[#*$%&<>=~^]{2,}"))
    bangs = F.regexp_count("_marks", F.lit(r"[!?]{2,}"))
    ends = F.regexp_count("_marks", F.lit(r"[.!?]"))
    votes = [
        _vote(_share(bars, n) < 0.01, _share(bars, n) > 0.1),
        _vote(_share(runs, n) < 0.01, _share(runs, n) > 0.1),
        _vote(_share(bangs, n) < 0.01, _share(bangs, n) > 0.1),
        _vote(_share(F.col("_twice"), n) < 0.02, _share(F.col("_twice"), n) > 0.15),
        _vote((n < 400) & (_share(F.col("_unlike"), n) > 0.5), (n >= 50) & (_share(F.col("_unlike"), n) < 0.1)),
        _vote(_share(F.col("_function"), n) > 0.15, (n >= 30) & (_share(F.col("_function"), n) < 0.05)),
        _vote(_share(F.col("_capitals"), n) < 0.05, _share(F.col("_capitals"), n) > 0.4),
        _vote(_share(ends, n).between(0.02, 0.35), (n >= 50) & (_share(ends, n) < 0.005)),
        _vote((n > 0) & (F.col("_size") < 9 * n), (n > 0) & (F.col("_size") > 14 * n)),
    ]
    return step.select(*docs.columns, "words", F.concat(*votes).alias("pattern"))


def estimate(patterns: list[str], counts: list[int], rounds: int = ROUNDS) -> np.ndarray:
    """The probability of good quality of each pattern.

    Expectation maximisation with two accuracies for each labeller, those of its votes on good and on bad documents. It
    begins with the share of 1 among the votes of a pattern. A light prior keeps accuracies above one half, so that good
    stays good.
    """
    votes = np.array([[c for c in pattern] for pattern in patterns])
    n = np.array(counts, float)
    yes, no = votes == "1", votes == "0"
    cast = (yes | no).sum(axis=1)
    p = np.where(cast > 0, (yes.sum(axis=1) - 2.0 * no.sum(axis=1) + 2) / np.maximum(cast + 4, 1), 0.5).clip(0.02, 0.98)
    for _ in range(rounds):
        good, bad = n * p, n * (1 - p)
        prior = (good.sum() + 1) / (n.sum() + 2)
        right_good = ((good[:, None] * yes).sum(0) + 8) / ((good[:, None] * (yes | no)).sum(0) + 10)
        right_bad = ((bad[:, None] * no).sum(0) + 1) / ((bad[:, None] * (yes | no)).sum(0) + 5)
        odds = np.log(prior / (1 - prior)) + yes @ np.log(right_good / (1 - right_bad)) + no @ np.log(
            (1 - right_good) / right_bad)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def posteriors(voted: DataFrame) -> DataFrame:
    """``(pattern, posterior, n)``, one row for each pattern there is."""
    rows = voted.groupBy("pattern").count().orderBy("pattern").collect()
    found = estimate([r["pattern"] for r in rows], [r["count"] for r in rows]) if rows else []
    return voted.sparkSession.createDataFrame(
        [(r["pattern"], float(p), r["count"]) for r, p in zip(rows, found)], "pattern string, posterior double, n bigint")


def features(frame: DataFrame) -> DataFrame:
    """Add ``features``: hashed counts of the words, of signs next to them and of words that repeat the one before, scaled
    to length one."""
    twice = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.when(a == b, F.lit("same again")))
    signs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[#*$%&<>=~^!?\x7C]+"), F.lit(0))
    tokens = F.concat("words", F.filter(twice, lambda t: t.isNotNull()), F.transform(
        signs, lambda s: F.concat(F.lit("sign "), s)))
    tf = HashingTF(numFeatures=FEATURES, inputCol="_tokens", outputCol="_counts")
    scaled = Normalizer(inputCol="_counts", outputCol="features").transform(tf.transform(frame.withColumn("_tokens", tokens)))
    return scaled.drop("_tokens", "_counts")


def scorer(docs: DataFrame, rows: int = TRAINING_ROWS):
    """The fitted model, or None where there is nothing to learn from."""
    voted = with_votes(docs.select("doc_id", "text"))
    labels = posteriors(voted.select("pattern"))
    known = labels.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not known:
        return None
    # Rows alike in id and text have one hash, so they count once.
    chosen = docs.select("doc_id", "text").filter(
        F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(known)) < F.lit(min(rows, known))).dropDuplicates()
    if not chosen.take(1):
        return None
    named = features(with_votes(chosen)).join(F.broadcast(labels), "pattern").select("features", "posterior")
    # The fit goes over the sample, which is bounded, again and again: few tasks, each with enough to do.
    named = named.repartition(TRAINING_TASKS)
    both = named.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))).alias("at")).select(
        "features", "at.label", "at.weight")
    return LogisticRegression(maxIter=50, regParam=1e-6, weightCol="weight", standardization=False).fit(both)


def scored(docs: DataFrame) -> DataFrame:
    """``(row, score)``: ``row`` holds the columns of the input."""
    model = scorer(docs)
    step = docs.select(F.struct("*").alias("row"), "text")
    if model is None:
        return step.select("row", F.lit(0.5).alias("score"))
    model.setFeaturesCol("features").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y")
    judged = model.transform(features(step.withColumn("words", split_words(F.col("text")))))
    return judged.select("row", F.round(vector_to_array("_p")[1], 6).alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text")).select(
        "row.doc_id", "score", (F.col("score") >= LEAST_SCORE).alias("kept"))
