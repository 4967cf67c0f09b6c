"""Queries over model requests and responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from newslens.functions.modeljson import error_class, extract_json
from newslens.operators import evaluation, learning, scoring
from newslens.plans import views as v
from newslens.plans.registry import query
from newslens.plans.story_queries import group_responses
from newslens.session import run_dir, staged


@query("extract_json", """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'sin grupos' ELSE concat('[{"event":"hecho ', doc_id, '","items":[', doc_id % 7 + 1, ',', doc_id % 5 + 1, ',', doc_id % 3 + 1,
  ',99]},{"event":" otro ","items":[', doc_id % 4 + 1, ',', doc_id % 7 + 1, ',2]}]') END AS json FROM documents
""")
def extract_json_query(spark, sf):
    return group_responses(spark, sf).select("doc_id", extract_json(F.col("response")).alias("json"))


@query("parse_model_json", """
SELECT edition_date, batch_no, provider_rank, item_index, relation_type, confidence, passed AND relation_type <> 'none' AS is_international,
  concat('regla ', relation_type) AS reason, array_to_string(m_countries, ',') AS countries, array_to_string(m_companies, ',') AS companies
FROM answer WHERE status = 'ok'
""", ("answer",))
def parse_model_json_query(spark, sf):
    items = scoring.response_items(scoring.parse_responses(v.responses(spark, sf)))
    return items.withColumns({c: F.array_join(c, ",") for c in ("countries", "companies")})


def reconciled(spark, sf):
    return scoring.batch_reconcile(v.batch_items(spark, sf), scoring.parse_responses(v.responses(spark, sf)))


@query("batch_reconcile", """
SELECT edition_date, batch_no, item_index, seq, provider_rank, status, CASE WHEN status = 'ok' THEN relation_type END AS relation_type FROM answer
""", ("answer",))
def batch_reconcile(spark, sf):
    return reconciled(spark, sf).select("edition_date", "batch_no", "item_index", "seq", "provider_rank", "status", "relation_type")


@query("topup_missing", "SELECT edition_date, batch_no, item_index, seq, provider_rank FROM answer WHERE status = 'missing'", ("answer",))
def topup_missing(spark, sf):
    return scoring.topup_missing(reconciled(spark, sf)).select("edition_date", "batch_no", "item_index", "seq", "provider_rank")


@query("provider_cascade", """
SELECT edition_date, seq, min(provider_rank) FILTER (status = 'ok') AS provider_rank, any_value(relation_type) FILTER (status = 'ok') AS relation_type
FROM answer GROUP BY edition_date, seq
""", ("answer",))
def provider_cascade(spark, sf):
    best = scoring.provider_cascade(v.batch_items(spark, sf), reconciled(spark, sf))
    return best.select("edition_date", "seq", "provider_rank", "relation_type")


@query("provider_failures", "SELECT provider_rank, status, count(*) AS items FROM answer GROUP BY ALL", ("answer",))
def provider_failures(spark, sf):
    return scoring.provider_failures(reconciled(spark, sf))


@query("error_class", """
SELECT event_type, class, count(*) AS failures FROM (
  SELECT event_type, CASE WHEN event_type = 'click' THEN 'hard_quota' WHEN event_type IN ('view', 'signup', 'error') THEN 'transient' ELSE 'other' END AS class FROM events)
GROUP BY ALL
""")
def error_class_query(spark, sf):
    body = F.create_map(*[F.lit(x) for pair in {
        "view": "Provider returned error", "click": "429: Check your plan and billing, then try again", "purchase": "invalid key",
        "signup": "Model OVERLOADED", "error": "Internal Server Error",
    }.items() for x in pair])
    text = F.concat(F.try_element_at(body, F.col("event_type")), F.lit(" #"), F.col("event_id").cast("string"))
    return v.table(spark, sf, "events").select("event_type", error_class(text).alias("class")).groupBy("event_type", "class").agg(F.count("*").alias("failures"))


@query("batch_prompt_text", """
SELECT edition_date, batch_no, count(*) AS items, string_agg(concat(item_index, '. Título: ', title, chr(10), 'Snippet: ', snippet, chr(10), chr(10)), '' ORDER BY item_index) AS prompt
FROM batch_item GROUP BY ALL
""", ("batch_item",))
def batch_prompt_text(spark, sf):
    return scoring.batch_prompt_text(v.batch_items(spark, sf))


def title_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a model: long titles are international; a batch whose first seq is a multiple of 5 fails."""
    if batch["seq"].min() % 5 == 0:
        raise TimeoutError("overloaded")
    size = batch["title"].str.len()
    return pd.DataFrame({"is_international": size > 100, "confidence": (size % 10) / 10.0})


@query("score_batches", """
SELECT edition_date, batch_no, item_index, seq, CASE WHEN f % 5 <> 0 THEN length(title) > 100 END AS is_international,
  CASE WHEN f % 5 <> 0 THEN CAST(length(title) % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END AS confidence, CASE WHEN f % 5 = 0 THEN 'overloaded' END AS error
FROM (SELECT *, min(seq) OVER (PARTITION BY edition_date, batch_no) AS f FROM batch_item)
""", ("batch_item",))
def score_batches(spark, sf):
    return scoring.score_batches(v.batch_items(spark, sf), title_scorer, ["title"], "is_international boolean, confidence double")


def _chain():
    """Stand-ins for three providers: one fails some batches and skips items, one fails others, one never answers some items."""

    def first(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["seq"].min() % 5 == 0:
            raise TimeoutError("overloaded")
        skipped = (batch["seq"] % 7 == 3) & ((len(batch) > 1) | (batch["seq"] % 2 == 1))
        return _sizes(batch[~skipped])

    def second(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["seq"].min() % 3 == 0:
            raise ValueError("no key")
        return _sizes(batch)

    return [first, second, lambda batch: _sizes(batch[batch["seq"] % 11 != 0])]


def _sizes(batch: pd.DataFrame) -> pd.DataFrame:
    return batch[["seq"]].assign(is_international=batch["title"].str.len() > 100)


@query("score_cascade", """
SELECT * FROM (WITH a AS (SELECT edition_date, seq, length(title) > 100 AS said, f % 5 = 0 AS failed, f % 5 <> 0 AND seq % 7 = 3 AS skipped FROM (
    SELECT *, min(seq) OVER (PARTITION BY edition_date, batch_no) AS f FROM batch_item)),
b AS (SELECT *, CASE WHEN failed THEN 'next' WHEN NOT skipped THEN 'first' WHEN seq % 5 <> 0 AND seq % 2 = 0 THEN 'again' ELSE 'next' END AS went FROM a),
c AS (SELECT edition_date, seq, said, CAST(skipped AS INTEGER) AS more, (row_number() OVER (PARTITION BY edition_date ORDER BY seq) - 1) // 16 AS no FROM b WHERE went = 'next'),
d AS (SELECT *, min(seq) OVER (PARTITION BY edition_date, no) % 3 = 0 AS failed FROM c)
SELECT edition_date, seq, 1 AS provider_rank, CASE went WHEN 'first' THEN 1 ELSE 2 END AS attempts, 'ok' AS status, said AS is_international, NULL::VARCHAR AS error FROM b WHERE went <> 'next'
UNION ALL SELECT edition_date, seq, 2, 2 + more, 'ok', said, NULL FROM d WHERE NOT failed
UNION ALL SELECT edition_date, seq, 3, 3 + more, 'ok', said, NULL FROM d WHERE failed AND seq % 11 <> 0
UNION ALL SELECT edition_date, seq, NULL, 4 + more, 'error', NULL, 'no answer' FROM d WHERE failed AND seq % 11 = 0)
""", ("batch_item",))
def score_cascade(spark, sf):
    """The cascade as rounds: each provider gets only what the ones before it left open."""
    return scoring.score_cascade(v.batch_items(spark, sf).select("edition_date", "seq", "title"), _chain(), ["title"], "is_international boolean")


_LABELLED = """
SELECT doc_id AS id, quality = 1 AS expected, list_distinct(regexp_extract_all(lower(replace(coalesce(text, ''), 'İ', 'i')), '[\\p{L}\\p{N}]+')) AS w
FROM documents JOIN labels USING (doc_id)
"""


@query("train_classifier", f"""
WITH d AS ({_LABELLED}), n AS (SELECT count(*) FILTER (expected) AS yes, count(*) FILTER (NOT expected) AS no FROM d),
e AS (SELECT id, expected, CAST(expected AS INTEGER) AS y, unnest(w) AS word FROM d),
m AS (SELECT word, sum(y) AS in_yes, count(*) - sum(y) AS in_no FROM e GROUP BY word),
s AS (SELECT id, sum(CAST(round(ln((in_yes - y + 1.0::DOUBLE) / (yes - y + 2.0::DOUBLE)) - ln((in_no - (1 - y) + 1.0::DOUBLE) / (no - (1 - y) + 2.0::DOUBLE)), 6)
  AS DECIMAL(18,6))) AS score FROM e JOIN m USING (word), n GROUP BY id)
SELECT id, expected, coalesce(score > 0, false) AS predicted, false AS error, 'learned' AS model FROM d LEFT JOIN s USING (id)
""")
def train_classifier(spark, sf):
    """Scorer learned from the labelled documents; each is judged by what the others teach."""
    labelled = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text"), (F.col("quality") == 1).alias("expected")
    )
    return learning.predict(labelled, labelled, held_out=True)


@query("train_pipeline")
def train_pipeline(spark, sf):
    """Precision, recall and F1 on the held-out fifth of the labelled documents: a stored and reloaded pipeline beside the word odds."""
    labelled = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text"), (F.col("quality") == 1).alias("expected")
    )
    train, test = (staged(labelled.where((F.pmod("id", F.lit(5)) == 0) == held)) for held in (False, True))
    path = run_dir(spark, "classifier")
    learning.fit_pipeline(train).write().save(path)
    both = learning.predict(train, test).unionByName(learning.predict_pipeline(path, test))
    return evaluation.prf1(evaluation.confusion(both))
