"""Queries over labels, votes and review samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.operators import evaluation, reports
from newslens.plans import views as v
from newslens.plans.registry import query
from newslens.sources import evalset

_CELLS = """
SELECT model, count(*) FILTER (NOT error AND predicted AND expected) AS tp, count(*) FILTER (NOT error AND predicted AND NOT expected) AS fp,
  count(*) FILTER (NOT error AND NOT predicted AND expected) AS fn, count(*) FILTER (NOT error AND NOT predicted AND NOT expected) AS tn,
  count(*) FILTER (error) AS errors
FROM prediction GROUP BY model
"""


@query("confusion", _CELLS, ("prediction",))
def confusion(spark, sf):
    return evaluation.confusion(v.predictions(spark, sf))


@query("prf1", f"""
SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE p * r * 2 / (p + r) END AS f1, tp + tn AS "right", tp + tn + fp + fn AS judged
FROM (SELECT *, p AS precision, r AS recall FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM ({_CELLS})))
""".replace("SELECT *, CASE WHEN p + r", "SELECT * EXCLUDE (p, r), CASE WHEN p + r"), ("prediction",))
def prf1(spark, sf):
    return evaluation.prf1(evaluation.confusion(v.predictions(spark, sf)))


_CONSENSUS = """
SELECT id, expected, CASE WHEN n = 3 AND a = y THEN CASE WHEN a = expected THEN 'confirmada' ELSE 'cambiada' END ELSE 'sin_consenso' END AS outcome,
  CASE WHEN n = 3 AND a = y AND a <> expected THEN a ELSE expected END AS label
FROM (SELECT doc_id AS id, (quality = 1) <> (doc_id % 7 = 0) AS expected FROM labels)
LEFT JOIN (SELECT id, count(vote) AS n, bool_and(vote) AS a, bool_or(vote) AS y FROM vote GROUP BY id) USING (id)
"""


def consensus(spark, sf):
    return evaluation.label_consensus(v.label_examples(spark, sf), v.judge_votes(spark, sf), 3)


@query("label_consensus", _CONSENSUS, ("vote",))
def label_consensus(spark, sf):
    return consensus(spark, sf)


@query("consensus_summary", f"SELECT outcome, count(*) AS labels FROM ({_CONSENSUS}) GROUP BY outcome", ("vote",))
def consensus_summary(spark, sf):
    return evaluation.consensus_summary(consensus(spark, sf))


@query("judge_guard", """
SELECT judge FROM (SELECT DISTINCT judge FROM (SELECT judge FROM vote UNION ALL SELECT concat('reserve ', quality) FROM labels))
WHERE judge NOT IN (SELECT judge FROM vote WHERE vote IS NOT NULL)
""", ("vote",))
def judge_guard(spark, sf):
    reserves = v.table(spark, sf, "labels").select(F.concat(F.lit("reserve "), F.col("quality").cast("string")).alias("judge"))
    votes = v.judge_votes(spark, sf)
    return evaluation.judge_guard(votes.select("judge").unionByName(reserves).distinct(), votes)


@query("eval_scan", """
SELECT CAST(doc_id AS VARCHAR) AS id, text AS title, source, quality = 1 AS expected FROM documents JOIN labels USING (doc_id)
""")
def eval_scan(spark, sf):
    """The labelled documents written as JSON lines, blank ones in between, and read back."""
    labelled = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id")
    line = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), "source", (F.col("quality") == 1).alias("expected")
    ))
    lines = labelled.select(F.explode(F.array(line, F.lit("  "))).alias("value"))
    return evalset.parse_examples(lines).select("id", "title", "source", "expected")


@query("review_sample_headlines", """
SELECT edition_date, seq, source, stage FROM (
  SELECT * FROM audit WHERE stage IN ('accepted', 'classifier_rejected')
    AND edition_date >= (SELECT max(edition_date) FROM headline) - 6 ORDER BY md5(concat('review', seq)) LIMIT 20)
""", ("audit", "headline"))
def review_sample_headlines(spark, sf):
    newest = v.headlines(spark, sf).agg(F.max("edition_date")).scalar()
    decided = v.audit_rows(spark, sf).where(
        F.col("stage").isin("accepted", "classifier_rejected") & (F.col("edition_date") >= F.date_sub(newest, 6))
    )
    return evaluation.review_sample(decided, F.col("seq"), 20, "review").select("edition_date", "seq", "source", "stage").orderBy("edition_date")


def report_claims(spark, sf):
    return reports.claims(reports.resolve_citations(v.stored_reports(spark, sf), v.notes(spark, sf)))


@query("review_sample_claims", """
SELECT edition_date, report_id, claim_no, text, array_to_string(links, ' ') AS links FROM claim
ORDER BY md5(concat('review', report_id, ' ', claim_no)) LIMIT 10
""", ("claim",))
def review_sample_claims(spark, sf):
    key = F.concat(F.col("report_id").cast("string"), F.lit(" "), F.col("claim_no").cast("string"))
    sample = evaluation.review_sample(report_claims(spark, sf), key, 10, "review")
    return sample.select("edition_date", "report_id", "claim_no", "text", F.array_join("links", " ").alias("links"))


@query("review_pool", """
SELECT 'headline' AS kind, edition_date, seq AS item, source, title AS text, stage, NULL::INTEGER AS claim_no, NULL AS section FROM audit
WHERE stage IN ('accepted', 'classifier_rejected') AND edition_date >= DATE '2024-01-24'
UNION ALL
SELECT 'claim', edition_date, report_id, NULL, text, NULL, claim_no, section FROM claim WHERE edition_date >= DATE '2024-01-24'
""", ("audit", "claim"))
def review_pool(spark, sf):
    return evaluation.review_pool(v.audit_rows(spark, sf), report_claims(spark, sf), F.lit("2024-01-24").cast("date"))
