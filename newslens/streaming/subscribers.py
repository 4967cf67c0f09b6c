"""Double opt-in over an event stream, one state per subscriber."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newslens.functions.text import epoch_us
from newslens.operators.transitions import Rules, advance
from newslens.streaming.batches import in_order

OUT = "subscriber bigint, event_id bigint, us bigint, action string, outcome string"
STATE = "confirmed_at bigint, unsubscribed_at bigint, sent_at bigint"


def optin_stream(events: DataFrame, rules: Rules) -> DataFrame:
    """Outcome of each event of a stream (subscriber, ts, event_id, action), as the batch operator gives it."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, times, actions = in_order(frames, ["event_id", "us", "action"])
        row, outcomes = (state.get if state.exists else None), []
        for action, us in zip(actions, times, strict=True):
            row, outcome = advance(row, action, us, rules)
            outcomes.append(outcome)
        if row is not None:
            state.update(row)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"subscriber": key[0], "event_id": numbers, "us": times, "action": actions, "outcome": outcomes})

    keyed = events.select("subscriber", "event_id", epoch_us(F.col("ts")).alias("us"), "action")
    return keyed.groupBy("subscriber").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
