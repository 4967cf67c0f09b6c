"""Classifier evaluation, label consensus and samples for human review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes of a label check.
CONFIRMED, CHANGED, NO_CONSENSUS = "confirmada", "cambiada", "sin_consenso"


def confusion(predictions: DataFrame) -> DataFrame:
    """tp, fp, fn, tn and technical errors per model; rows with an error are in no cell."""
    ok, got, want = ~F.col("error"), F.col("predicted"), F.col("expected")
    return predictions.groupBy("model").agg(
        F.count_if(ok & got & want).alias("tp"), F.count_if(ok & got & ~want).alias("fp"),
        F.count_if(ok & ~got & want).alias("fn"), F.count_if(ok & ~got & ~want).alias("tn"),
        F.count_if(F.col("error")).alias("errors"),
    )


def prf1(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1; an empty denominator gives 0."""
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, p, r = F.col("tp"), F.col("precision"), F.col("recall")
    return (
        cells.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn"))})
        .withColumn("f1", ratio(p * r * 2, p + r))
        .withColumn("right", tp + F.col("tn"))
        .withColumn("judged", tp + F.col("tn") + F.col("fp") + F.col("fn"))
    )


def label_consensus(examples: DataFrame, votes: DataFrame, judges: int) -> DataFrame:
    """Outcome of the vote on each label (id, expected): a unanimous vote of all judges decides, else it stays."""
    tally = votes.where(F.col("vote").isNotNull()).groupBy("id").agg(
        F.count_distinct("judge").alias("_judges"), F.bool_and("vote").alias("_all"), F.bool_or("vote").alias("_any")
    )
    unanimous = (F.col("_judges") == judges) & (F.col("_all") == F.col("_any"))
    outcome = (
        F.when(F.coalesce(unanimous, F.lit(False)), F.when(F.col("_all") == F.col("expected"), CONFIRMED).otherwise(CHANGED))
        .otherwise(NO_CONSENSUS)
    )
    return (
        examples.join(tally, "id", "left").withColumn("outcome", outcome)
        .withColumn("label", F.when(F.col("outcome") == CHANGED, F.col("_all")).otherwise(F.col("expected")))
        .drop("_judges", "_all", "_any")
    )


def consensus_summary(consensus: DataFrame) -> DataFrame:
    return consensus.groupBy("outcome").agg(F.count("*").alias("labels"))


def judge_guard(judges: DataFrame, votes: DataFrame) -> DataFrame:
    """Judges without a single vote; labels are only rewritten when there are none."""
    voted = votes.where(F.col("vote").isNotNull()).select("judge").distinct()
    return judges.join(voted, "judge", "left_anti")


def review_sample(rows: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """`n` rows in a random but repeatable choice: the smallest hashes of seed and key. Each task keeps n rows."""
    return (
        rows.withColumn("_draw", F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")))
        .orderBy("_draw").limit(n).drop("_draw")
    )


def review_pool(audit: DataFrame, claims: DataFrame, since: Column) -> DataFrame:
    """Decided headlines and cited claims of the editions from `since` on, in one table."""
    heads = audit.where((F.col("edition_date") >= since) & F.col("stage").isin("accepted", "classifier_rejected")).select(
        F.lit("headline").alias("kind"), "edition_date", F.col("seq").alias("item"), "source", F.col("title").alias("text"), "stage"
    )
    said = claims.where(F.col("edition_date") >= since).select(
        F.lit("claim").alias("kind"), "edition_date", F.col("report_id").alias("item"), "claim_no", "section", "text"
    )
    return heads.unionByName(said, allowMissingColumns=True)
