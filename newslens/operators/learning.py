"""Scorers learned from labelled text: word counts per class with smoothing, as plain aggregations, and a pipeline of hashed terms with regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.functions.text import lower_simple
from newslens.session import run_dir

#: Smoothing of the word shares, and the digits to which a log-odds is kept so that sums don't depend on their order.
SMOOTHING = 1.0
DIGITS = 6
#: Features of the pipeline, its regularisation, folds that choose its threshold, and steps of the threshold.
FEATURES, REGULARISATION, FOLDS, STEPS = 1 << 14, 0.01, 3, 100


def words_of(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(lower_simple(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, in_yes, in_no) from rows (text, expected). Counts are combined before the shuffle; the model stays a table."""
    rows = labelled.select(F.col("expected").cast("int").alias("y"), F.explode(words_of(F.col("text"))).alias("word"))
    return rows.groupBy("word").agg(F.sum("y").alias("in_yes"), (F.count("*") - F.sum("y")).alias("in_no"))


def _odds(in_yes: Column, in_no: Column, yes: Column, no: Column) -> Column:
    share = lambda n, total: (n + SMOOTHING) / (total + 2 * SMOOTHING)
    return F.round(F.log(share(in_yes, yes)) - F.log(share(in_no, no)), DIGITS).cast("decimal(18,6)")


def predict(labelled: DataFrame, rows: DataFrame, held_out: bool = False) -> DataFrame:
    """(id, expected, predicted) in the shape the evaluation reads: expected if the odds of the row's known words add up to more than 0.

    `held_out`: `rows` are among `labelled`, and each is judged by the counts of all others.
    """
    totals = labelled.agg(F.coalesce(F.sum(F.col("expected").cast("int")), F.lit(0)).alias("yes"), F.count("*").alias("all")).first()
    y = F.col("expected").cast("int") if held_out else F.lit(0)
    n = (1 - y) if held_out else F.lit(0)
    words = rows.select("id", "expected", F.explode(words_of(F.col("text"))).alias("word")).join(word_counts(labelled), "word")
    odds = _odds(F.col("in_yes") - y, F.col("in_no") - n, totals["yes"] - y, (totals["all"] - totals["yes"]) - n)
    scores = words.groupBy("id").agg(F.sum(odds).alias("score"))
    return rows.select("id", "expected").join(scores, "id", "left").select(
        "id", "expected", F.coalesce(F.col("score") > 0, F.lit(False)).alias("predicted"), F.lit(False).alias("error"), F.lit("learned").alias("model")
    )


def _stages(threshold: float) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}]+", gaps=False),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=FEATURES),
        IDF(inputCol="counts", outputCol="features", minDocFreq=2),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=REGULARISATION, maxIter=50, threshold=threshold),
    ])


def _examples(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.coalesce("text", F.lit("")).alias("text"), "expected", F.col("expected").cast("double").alias("label"))


def _stored(model: PipelineModel) -> PipelineModel:
    """The model written out and read back: without the training rows, to which a fitted one holds on in every task."""
    path = run_dir(SparkSession.active(), "fold")
    model.write().save(path)
    return PipelineModel.load(path)


def best_threshold(scored: DataFrame) -> float:
    """The threshold, in steps of 1 / STEPS, with the largest F1 on rows (probability, expected); ties: the lowest.

    Rows are first counted by step, so STEPS rows at most reach the driver.
    """
    step = F.least(F.floor(F.col("probability") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step")
    counts = {r["step"]: r for r in scored.groupBy(step).agg(F.count_if("expected").alias("yes"), F.count("*").alias("all")).collect()}
    positive = sum(r["yes"] for r in counts.values())
    best, found, said, hit = 0.0, 0.5, 0, 0
    for k in reversed(range(STEPS)):
        if k in counts:
            said, hit = said + counts[k]["all"], hit + counts[k]["yes"]
            f1 = 2 * hit / (said + positive) if said + positive else 0.0
            if f1 >= best and f1 > 0:
                best, found = f1, k / STEPS
    return found


def fit_pipeline(labelled: DataFrame, folds: int = FOLDS) -> PipelineModel:
    """Tokenizer, hashed term counts, inverse document frequencies and logistic regression from rows (id, text, expected).

    The threshold is chosen by cross-validation: each fold, by a hash of the id, is scored by a model of the others, and all those scores
    together tell the threshold of the model that is fitted on everything. Empty or one-sided examples leave it at 0.5.
    """
    examples = _examples(labelled)
    fold = F.pmod(F.xxhash64("id"), F.lit(folds))
    scored = None
    for k in range(folds):
        train, test = examples.where(fold != k), examples.where(fold == k)
        if train.select("label").distinct().count() < 2:
            continue
        part = _stored(_stages(0.5).fit(train)).transform(test).select("expected", F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))
        scored = part if scored is None else scored.unionByName(part)
    return _stages(0.5 if scored is None else best_threshold(scored)).fit(examples)


def predict_pipeline(path: str, rows: DataFrame) -> DataFrame:
    """(id, expected, predicted) by a stored model, in the shape the evaluation reads."""
    out = PipelineModel.load(path).transform(_examples(rows))
    return out.select("id", "expected", (F.col("prediction") == 1).alias("predicted"), F.lit(False).alias("error"), F.lit("pipeline").alias("model"))
