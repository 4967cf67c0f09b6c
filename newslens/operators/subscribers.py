"""Double opt-in: state of every subscriber and outcome of every request, folded from the event log.

A subscriber with few events is folded in one array expression. The events of a busy one are cut into chunks along their order. Each chunk is
first reduced to its `Transfer`, a function of the state before it; the functions are composed within groups of chunks, and the few functions of
groups chained, which yields the state before every group, then before every chunk; then all chunks are replayed side by side. The number of jobs
is the same however often a subscriber's state changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.text import epoch_us
from newslens.operators.folds import fold_groups
from newslens.operators.numbering import sliced_row_number
from newslens.operators.transitions import CONFIRM, FIELDS, PURGE, SUBSCRIBE, UNSUBSCRIBE, Row, Rules, Transfer, advance, composed
from newslens.session import staged

SMALL_SUBSCRIBER = 2048
#: Events in a chunk, and chunks whose functions are composed in one task.
CHUNK_EVENTS, GROUP_CHUNKS = 4096, 256

_STATE = ["present", "confirmed_at", "unsubscribed_at", "sent_at"]


def _outcome(s: dict[str, Column], action: Column, us: Column, rules: Rules) -> Column:
    active = s["present"] & s["confirmed_at"].isNotNull() & s["unsubscribed_at"].isNull()
    throttled = s["present"] & (F.coalesce(s["sent_at"], F.lit(0)) >= us - rules.resend_seconds * 1_000_000)
    valid = s["present"] & s["confirmed_at"].isNull() & (s["sent_at"] > us - rules.ttl_seconds * 1_000_000)
    expired = s["present"] & s["confirmed_at"].isNull() & (s["sent_at"] < us - rules.ttl_seconds * 1_000_000)
    return (
        F.when(action == SUBSCRIBE, F.when(active, "already_active").when(throttled, "throttled").otherwise("needs_confirmation"))
        .when(action == CONFIRM, F.when(valid, "confirmed").otherwise("confirm_failed"))
        .when(action == UNSUBSCRIBE, F.when(s["present"] & s["unsubscribed_at"].isNull(), "unsubscribed").otherwise("unchanged"))
        .when(action == PURGE, F.when(expired, "purged").otherwise("kept"))
    )


def _after(s: dict[str, Column], outcome: Column, us: Column) -> dict[str, Column]:
    none = F.lit(None).cast("bigint")
    sent, confirmed = outcome == "needs_confirmation", outcome == "confirmed"
    gone = outcome == "purged"
    return {
        "present": F.when(sent, True).when(gone, False).otherwise(s["present"]),
        "confirmed_at": F.when(sent | gone, none).when(confirmed, us).otherwise(s["confirmed_at"]),
        "unsubscribed_at": F.when(sent | confirmed | gone, none).when(outcome == "unsubscribed", us).otherwise(s["unsubscribed_at"]),
        "sent_at": F.when(sent, us).when(gone, none).otherwise(s["sent_at"]),
    }


def _blank() -> dict[str, Column]:
    none = F.lit(None).cast("bigint")
    return {"present": F.lit(False), "confirmed_at": none, "unsubscribed_at": none, "sent_at": none}


def _struct(s: dict[str, Column]) -> Column:
    return F.struct(*[s[k].alias(k) for k in _STATE])


def _fields(c: Column) -> dict[str, Column]:
    return {k: c[k] for k in _STATE}


def _fold_small(events: DataFrame, rules: Rules) -> DataFrame:
    row = "struct<event_id:bigint,us:bigint,action:string,outcome:string,state:struct<present:boolean,confirmed_at:bigint,unsubscribed_at:bigint,sent_at:bigint>>"

    def step(acc: Column, e: Column) -> Column:
        before = _fields(acc["state"])
        outcome = _outcome(before, e["action"], e["us"], rules)
        after = _struct(_after(before, outcome, e["us"]))
        made = F.struct(e["event_id"].alias("event_id"), e["us"].alias("us"), e["action"].alias("action"), outcome.alias("outcome"), after.alias("state"))
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(made)).alias("out"))

    start = F.struct(_struct(_blank()).alias("state"), F.array().cast(f"array<{row}>").alias("out"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "us", "action")))
    folded = F.aggregate(F.col("_e"), start, step, lambda acc: acc["out"])
    return (
        events.groupBy("subscriber").agg(ordered.alias("_e")).select("subscriber", F.explode(folded).alias("_o"))
        .select("subscriber", "_o.event_id", "_o.us", "_o.action", "_o.outcome", "_o.state")
    )


_TRANSFER = ", ".join(f"{f} array<bigint>" for f in FIELDS)
_ROW = FIELDS[4:]
_BEFORE = "present boolean, " + ", ".join(f"{f} bigint" for f in _ROW)


def _transfer_row(t: Transfer) -> list[list[int]]:
    return [t.rows[f].tolist() for f in FIELDS]


def _transfer(lists: tuple) -> Transfer:
    return Transfer({f: np.array(x, np.int64) for f, x in zip(FIELDS, lists, strict=True)})


def _shown(row: Row | None) -> list:
    return [row is not None, *(row or (None, None, None))]


def _row(shown: tuple) -> Row | None:
    return tuple(shown[1:]) if shown[0] else None


def _walk(rows: Iterator[tuple], row: Row | None) -> Iterator[tuple]:
    """The state before each of the runs (subscriber, order, transfer, ...)."""
    for subscriber, order, *lists in rows:
        yield (subscriber, order, *_shown(row))
        row = _transfer(lists[: len(FIELDS)]).apply(row)


def _fold_large(events: DataFrame, rules: Rules, chunk_events: int, group_chunks: int) -> DataFrame:
    subscriber = f"subscriber {events.schema['subscriber'].dataType.simpleString()}"
    log = staged(events)
    numbered = sliced_row_number(log, ["subscriber"], [("event_id", True)], "_n")
    chunk = F.expr(f"(_n - 1) div {chunk_events}").alias("chunk")
    log = staged(numbered.select("subscriber", chunk, "event_id", "us", "action"))

    def reduce(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, us, actions = None, [], []
        for key, n, _, t, action in rows:
            us.append(t)
            actions.append(action)
        yield (key, n, *_transfer_row(Transfer.of(us, actions, rules)))

    def compose(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = list(rows)
        yield (*held[0][:2], *_transfer_row(composed([_transfer(r[3:]) for r in held])))

    def inside(rows: Iterator[tuple]) -> Iterator[tuple]:
        first = next(rows)
        yield from _walk((r[:2] + r[3:] for r in chain([first], rows)), _row(first[-4:]))

    def replayed(rows: Iterator[tuple]) -> Iterator[tuple]:
        row = _row(next(rows)[5:])
        for key, _, event_id, us, action, *_ in rows:
            row, outcome = advance(row, action, us, rules)
            yield (key, event_id, us, action, outcome, *_shown(row))

    chunks = staged(fold_groups(log, ["subscriber", "chunk"], ["event_id"], reduce, f"{subscriber}, chunk bigint, {_TRANSFER}"))
    chunks = chunks.select("subscriber", "chunk", F.expr(f"chunk div {group_chunks}").alias("part"), *FIELDS)
    parted = chunks.select("subscriber", "part", "chunk", *FIELDS)
    parts = fold_groups(parted, ["subscriber", "part"], ["chunk"], compose, f"{subscriber}, part bigint, {_TRANSFER}")
    before_part = fold_groups(parts, ["subscriber"], ["part"], lambda rows: _walk(rows, None), f"{subscriber}, part bigint, {_BEFORE}")
    met = chunks.join(before_part.withColumnsRenamed({f: f"_{f}" for f in _STATE}), ["subscriber", "part"])
    met = met.select("subscriber", "chunk", "part", *FIELDS, *[f"_{f}" for f in _STATE])
    before_chunk = fold_groups(met, ["subscriber", "part"], ["chunk"], inside, f"{subscriber}, chunk bigint, {_BEFORE}")
    # The state before a chunk comes as the first of its rows; `present` is null in those of events.
    started = log.unionByName(before_chunk, allowMissingColumns=True).select("subscriber", "chunk", "event_id", "us", "action", *_STATE)
    out = fold_groups(
        started, ["subscriber", "chunk"], [F.col("present").isNull(), "event_id"], replayed,
        f"{subscriber}, event_id bigint, us bigint, action string, outcome string, {_BEFORE}",
    )
    return out.select("subscriber", "event_id", "us", "action", "outcome", _struct({f: F.col(f) for f in _STATE}).alias("state"))


def optin_lifecycle(
    events: DataFrame, rules: Rules, small: int = SMALL_SUBSCRIBER, chunk_events: int = CHUNK_EVENTS, group_chunks: int = GROUP_CHUNKS
) -> DataFrame:
    """Outcome of every event (subscriber, ts, event_id, action) and the subscriber's state after it.

    `event_id` numbers the events in the order of arrival; state times are microseconds.
    """
    keyed = events.select("subscriber", "event_id", epoch_us(F.col("ts")).alias("us"), "action")
    busy = keyed.groupBy("subscriber").agg(F.count("*").alias("_k")).where(F.col("_k") > small).select("subscriber")
    quick = _fold_small(keyed.join(busy, "subscriber", "left_anti"), rules)
    if busy.isEmpty():
        return quick
    return quick.unionByName(_fold_large(keyed.join(busy, "subscriber", "left_semi"), rules, chunk_events, group_chunks))


def subscriber_states(lifecycle: DataFrame) -> DataFrame:
    """State of each subscriber after its last event; purged ones are gone. The id is the first event."""
    last = lifecycle.groupBy("subscriber").agg(
        F.min("event_id").alias("id"), F.max_by("state", "event_id").alias("state")
    )
    return last.select("id", "subscriber", "state.*").where("present").drop("present")


def active_subscribers(states: DataFrame) -> DataFrame:
    """Confirmed and not unsubscribed, in order of arrival."""
    return states.where(F.col("confirmed_at").isNotNull() & F.col("unsubscribed_at").isNull()).orderBy("id")


def confirmations_since(states: DataFrame, now_us: Column, seconds: int, cap: int) -> DataFrame:
    """Subscribers whose last confirmation went out in the trailing window, and whether that reaches the cap."""
    sent = F.count_if(F.col("sent_at") > now_us - seconds * 1_000_000)
    return states.agg(sent.alias("sent"), (sent >= cap).alias("capped"))
