"""Trailing count of confirmations against the daily cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.operators.numbering import sliced_running_sum


def trailing_sends(sends: DataFrame, hours: int, cap: int) -> DataFrame:
    """For each send (event_id, ts) how many went out in the `hours` up to it, and whether the cap was already reached.

    A send adds one at its time and takes it back when the window has passed, so the count is one running sum over
    slices of time instead of a range window over everything in one task.
    """
    enters = sends.select("event_id", F.col("ts").alias("at"), F.lit(1).alias("delta"))
    leaves = sends.select("event_id", (F.col("ts") + F.expr(f"INTERVAL {int(hours)} HOURS")).alias("at"), F.lit(-1).alias("delta"))
    running = sliced_running_sum(
        enters.unionByName(leaves), [], [("at", True), ("delta", True), ("event_id", True)], F.col("delta"), "in_window",
    )
    return running.where(F.col("delta") == 1).select(
        "event_id", F.col("at").alias("ts"), "in_window", (F.col("in_window") - 1 >= cap).alias("over_cap")
    )
