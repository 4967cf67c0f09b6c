"""Batched model scoring: batches, prompts, responses, reconciliation by index and the provider cascade."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions.modeljson import CLASSIFICATION_SCHEMA, parse_model_json
from newslens.operators.numbering import sliced_row_number
from newslens.session import staged

# Headlines per scoring request.
BATCH_SIZE = 16

BATCH = ["edition_date", "batch_no"]
FIELDS = ["is_international", "countries", "companies", "relation_type", "confidence", "reason"]

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def batch_assign(h: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Fixed-size batches per edition: adds batch_no and item_index, both from 0."""
    numbered = sliced_row_number(h, ["edition_date"], [("seq", True)], "_n")
    return numbered.withColumns({
        "batch_no": F.floor((F.col("_n") - 1) / size).cast("bigint"),
        "item_index": ((F.col("_n") - 1) % size).cast("int"),
    }).drop("_n")


def batch_prompt_text(batched: DataFrame) -> DataFrame:
    """Numbered text of each batch; a batch has at most BATCH_SIZE items."""
    item = F.concat(
        F.col("item_index").cast("string"), F.lit(". Título: "), F.col("title"), F.lit("\nSnippet: "), F.col("snippet"), F.lit("\n\n")
    )
    ordered = F.array_sort(F.collect_list(F.struct("item_index", item.alias("text"))))
    return batched.groupBy(*BATCH).agg(
        F.count("*").alias("items"), F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("prompt")
    )


def score_batches(batched: DataFrame, scorer: Scorer, columns: list[str], out_schema: str) -> DataFrame:
    """Runs `scorer` on each batch: a pandas frame with seq and `columns` in, one row per input row out.

    Batches are spread by hash over the cluster and stay whole within a task; the scorer sees one batch at a time. A
    scorer that fails marks its batch with the error and leaves the others alone.
    """
    key = [*BATCH, "item_index"]
    names = [c.split()[0] for c in out_schema.split(", ")]

    def score_one(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            scored = scorer(batch[["seq", *columns]].reset_index(drop=True))
            if len(scored) != len(batch):
                raise ValueError(f"{len(batch)} items in, {len(scored)} out")
            scored = scored.reindex(columns=names).assign(error=None)
        except Exception as e:  # noqa: BLE001 - any scorer failure becomes data
            scored = pd.DataFrame({n: [None] * len(batch) for n in names}).assign(error=str(e))
        return pd.concat([batch[["edition_date", "seq", *key[1:]]].reset_index(drop=True), scored.reset_index(drop=True)], axis=1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            ids = frame[BATCH].ne(frame[BATCH].shift()).any(axis=1).cumsum()
            rest = frame[ids == ids.iloc[-1]]
            for _, batch in frame[ids != ids.iloc[-1]].groupby(ids, sort=False):
                yield score_one(batch)
        if rest is not None and len(rest):
            yield score_one(rest)

    rows = batched.select(*key, "seq", *columns).repartition(*BATCH).sortWithinPartitions(*key)
    return rows.mapInPandas(run, f"edition_date date, seq bigint, batch_no bigint, item_index int, {out_schema}, error string")


def score_cascade(items: DataFrame, providers: list[Scorer], columns: list[str], out_schema: str, size: int = BATCH_SIZE) -> DataFrame:
    """Scores (edition_date, seq, and `columns`) by a chain of providers, until every item has an answer or the last provider has failed it.

    Each provider gets what is left, in batches of `size`, as a frame of seq and `columns`, and returns a frame with seq and the answers, in any
    order. Items that its answer skips are sent to it once more, one by one; a batch that raises, and items that it skips again, go to the
    next provider. Only what is left moves on, so a round costs what its items cost. Each round is written out, and the rounds end as soon as
    nothing is left. `attempts` counts how often an item was sent; `error` is the last provider's.
    """
    names = [c.split()[0] for c in out_schema.split(", ")]
    shape = f"{out_schema}, answered boolean"

    def aligned(provider: Scorer) -> Scorer:
        def score(batch: pd.DataFrame) -> pd.DataFrame:
            found = provider(batch).drop_duplicates("seq", keep="last").assign(answered=True)
            return batch[["seq"]].merge(found, on="seq", how="left")[[*names, "answered"]].astype(object)

        return score

    def round_of(left: DataFrame, provider: Scorer, batch: int) -> DataFrame:
        scored = score_batches(batch_assign(left.select("edition_date", "seq", *columns), batch), aligned(provider), columns, shape)
        status = F.when(F.col("error").isNotNull(), "error").when(F.col("answered"), "ok").otherwise("missing")
        return staged(scored.select("edition_date", "seq", *names, status.alias("status"), "error"))

    def still(left: DataFrame, result: DataFrame, *status: str) -> DataFrame:
        open_items = result.where(F.col("status").isin(*status)).select(F.col("seq").alias("_seq"), F.col("error").alias("_error"))
        met = left.join(open_items, F.col("seq") == F.col("_seq")).drop("_seq", "error")
        return staged(met.withColumn("attempts", F.col("attempts") + 1).withColumnRenamed("_error", "error"))

    start = items.select("edition_date", "seq", *columns).withColumns({"attempts": F.lit(0), "error": F.lit(None).cast("string")})
    left, done = staged(start), []

    def answers(result: DataFrame, left: DataFrame, rank: int) -> DataFrame:
        sent = left.select(F.col("seq").alias("_seq"), (F.col("attempts") + 1).alias("attempts"))
        ok = result.where(F.col("status") == "ok").join(sent, F.col("seq") == F.col("_seq"))
        return ok.select("edition_date", "seq", F.lit(rank).alias("provider_rank"), "attempts", "status", *names, F.lit(None).cast("string").alias("error"))

    for rank, provider in enumerate(providers, 1):
        if left.isEmpty():
            break
        first = round_of(left, provider, size)
        done.append(answers(first, left, rank))
        failed, skipped = still(left, first, "error"), still(left, first, "missing")
        if not skipped.isEmpty():
            again = round_of(skipped, provider, 1)
            done.append(answers(again, skipped, rank))
            failed = failed.unionByName(still(skipped, again, "error", "missing"))
        left = staged(failed)
    none = [F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in out_schema.split(", ")]
    lost = left.select(
        "edition_date", "seq", F.lit(None).cast("int").alias("provider_rank"), "attempts", F.lit("error").alias("status"), *none,
        F.coalesce("error", F.lit("no answer")).alias("error"),
    )
    for part in done:
        lost = lost.unionByName(part)
    return lost


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses (edition_date, batch_no, provider_rank, response) with typed `parsed` items, NULL when unreadable."""
    return responses.withColumn("parsed", parse_model_json(F.col("response"), CLASSIFICATION_SCHEMA))


def response_items(parsed: DataFrame) -> DataFrame:
    """One row per answered index; of repeated indexes the last counts."""
    rows = parsed.select(*BATCH, "provider_rank", F.posexplode("parsed").alias("pos", "item"))
    last = rows.groupBy(*BATCH, "provider_rank", F.col("item.index").alias("item_index")).agg(F.max_by("item", "pos").alias("item"))
    return last.select(*BATCH, "provider_rank", "item_index", *[f"item.{f}" for f in FIELDS])


def batch_reconcile(batched: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every item of every provider's batch with its answer: status ok, missing (skipped index) or error (unreadable)."""
    answers = response_items(parsed)
    readable = parsed.select(*BATCH, "provider_rank", F.col("parsed").isNotNull().alias("_readable"))
    status = F.when(~F.col("_readable"), "error").when(F.col("relation_type").isNull(), "missing").otherwise("ok")
    return (
        batched.select(*BATCH, "item_index", "seq").join(readable, BATCH)
        .join(answers, [*BATCH, "provider_rank", "item_index"], "left")
        .withColumn("status", status).drop("_readable")
    )


def topup_missing(reconciled: DataFrame) -> DataFrame:
    """Items a readable response skipped, to be scored again one by one."""
    return reconciled.where(F.col("status") == "missing")


def provider_cascade(batched: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Answer of the first provider in the chain that has one; provider_rank NULL when all of them failed.

    The winner is picked by aggregation over providers, which are few per item, and combined before the shuffle.
    """
    ok = reconciled.where(F.col("status") == "ok")
    best = ok.groupBy("seq").agg(F.min_by(F.struct("provider_rank", *FIELDS), "provider_rank").alias("_b"))
    return batched.select("edition_date", "seq").join(best, "seq", "left").select(
        "edition_date", "seq", "_b.provider_rank", *[f"_b.{f}" for f in FIELDS]
    )


def provider_failures(reconciled: DataFrame) -> DataFrame:
    """Items per provider and outcome."""
    return reconciled.groupBy("provider_rank", "status").agg(F.count("*").alias("items"))
