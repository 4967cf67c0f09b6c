"""Token buckets over a request stream, one state per client."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newslens.functions.text import epoch_us
from newslens.operators.admission import Rate, refilled_at, spend
from newslens.streaming.batches import in_order

OUT = "client string, event_id bigint, us bigint, admitted boolean, tokens bigint"
SWEPT = "client string, tokens bigint, last_us bigint, refilled_us bigint"
STATE = "tokens bigint, last bigint"


def admit_stream(requests: DataFrame, rate: Rate, delay: str = "1 hour") -> DataFrame:
    """Decision on each request of a stream (client, ts, event_id), as the batch operator gives it.

    A bucket that has had time to refill is dropped once the watermark passes that time: a new one is just as full.
    """
    refill_us = rate.full // rate.count + 1

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        numbers, us = in_order(frames, ["event_id", "us"])
        held, last = state.get if state.exists else (rate.full, us[0])
        admitted, tokens, held = spend(us, held, last, rate)
        refilled_ms = (us[-1] + refill_us) // 1000
        if refilled_ms > state.getCurrentWatermarkMs():
            state.update((held, us[-1]))
            state.setTimeoutTimestamp(refilled_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"client": key[0], "event_id": numbers, "us": us, "admitted": admitted, "tokens": tokens})

    timed = requests.withColumn("at", F.timestamp_micros(epoch_us(F.col("ts")))).withWatermark("at", delay)
    keyed = timed.select("client", "event_id", "at", epoch_us(F.col("ts")).alias("us"))
    return keyed.groupBy("client").applyInPandasWithState(decide, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sweep_stream(requests: DataFrame, rate: Rate, delay: str = "1 hour") -> DataFrame:
    """The buckets that have had time to refill: (client, tokens, last_us, refilled_us), as `admission.refills` gives them.

    A bucket is emitted once, by the first of two: a request that finds it full, or an event-time timer when the watermark passes the time at which
    it is full. So what comes out does not depend on how requests fall into batches.
    """

    def sweep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, bucket = [], state.get if state.exists else None

        def full(tokens: int, last: int) -> None:
            rows.append((key[0], tokens, last, refilled_at(tokens, last, rate)))

        if not state.hasTimedOut:
            for t in in_order(frames, ["us"])[0]:
                if bucket and t >= refilled_at(*bucket, rate):
                    full(*bucket)
                held, last = bucket or (rate.full, t)
                _, _, held = spend([t], held, last, rate)
                bucket = held, max(t, last)
        due_ms = -(-refilled_at(*bucket, rate) // 1000)
        if state.hasTimedOut or due_ms <= state.getCurrentWatermarkMs():
            full(*bucket)
            if state.exists:
                state.remove()
        else:
            state.update(bucket)
            state.setTimeoutTimestamp(due_ms)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SWEPT.split(", ")])

    timed = requests.withColumn("at", F.timestamp_micros(epoch_us(F.col("ts")))).withWatermark("at", delay)
    keyed = timed.select("client", "event_id", "at", epoch_us(F.col("ts")).alias("us"))
    return keyed.groupBy("client").applyInPandasWithState(sweep, SWEPT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
