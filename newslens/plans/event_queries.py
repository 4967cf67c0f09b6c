"""Queries over the event log: cost, budget, versions, admission and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.functions.text import client_key, date_label_es, epoch_us, normalize_email
from newslens.operators import admission, audit, signups, subscribers
from newslens.plans import views as v
from newslens.plans.registry import query

RATE = admission.Rate(count=1, per_seconds=6 * 3600, burst=3)
RULES = subscribers.Rules(resend_seconds=3 * 24 * 3600)


@query("cost_by_stage", """
SELECT run, stage, CAST(cost AS DOUBLE) AS cost, requests, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens
FROM (SELECT run, s AS stage, sum(cost) AS cost, count(*) AS requests, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens
      FROM (SELECT *, coalesce(stage, 'otros') AS s FROM usage_event) GROUP BY GROUPING SETS ((run, s), (run)))
""", ("usage_event",))
def cost_by_stage(spark, sf):
    return audit.cost_by_stage(v.usage_events(spark, sf)).withColumn("cost", F.col("cost").cast("double"))


@query("budget_gate", """
SELECT event_id, run, stage, CAST(spent AS DOUBLE) AS spent_before,
  coalesce(stage IN ('agrupamiento', 'fidelidad') AND spent >= 3, false) AS skipped
FROM (SELECT *, coalesce(sum(cost) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM usage_event)
""", ("usage_event",))
def budget_gate(spark, sf):
    gated = audit.budget_gate(v.usage_events(spark, sf), F.lit(3), ["agrupamiento", "fidelidad"])
    return gated.select("event_id", "run", "stage", F.col("spent_before").cast("double").alias("spent_before"), "skipped")


@query("edition_versions", "SELECT edition_date, event_id, generated_at, version, reason FROM versions", ("versions",))
def edition_versions(spark, sf):
    return audit.edition_versions(v.generations(spark, sf))


@query("latest_version", """
SELECT edition_date, version, reason FROM versions QUALIFY version >= 2 AND version = max(version) OVER (PARTITION BY edition_date)
""", ("versions",))
def latest_version(spark, sf):
    return audit.latest_version(audit.edition_versions(v.generations(spark, sf))).select("edition_date", "version", "reason")


@query("corrections", """
SELECT * FROM (SELECT edition_date, version, generated_at, reason, max(version) OVER (PARTITION BY edition_date) AS versions FROM versions) WHERE versions >= 2
""", ("versions",))
def corrections(spark, sf):
    history = audit.corrections(audit.edition_versions(v.generations(spark, sf)))
    return history.select("edition_date", "version", "generated_at", "reason", "versions")


@query("version_intervals", """
SELECT edition_date, event_id, reason, generated_at AS valid_from, lead(generated_at) OVER w AS valid_to, row_number() OVER w AS version
FROM versions WINDOW w AS (PARTITION BY edition_date ORDER BY generated_at, event_id)
""", ("versions",))
def version_intervals(spark, sf):
    versions = audit.version_intervals(audit.edition_versions(v.generations(spark, sf)).drop("version"))
    return versions.select("edition_date", "event_id", "reason", "valid_from", "valid_to", F.col("version").cast("bigint").alias("version"))


@query("edition_as_of", """
SELECT e.event_id AS asked, e.moment, n AS version, i.event_id FROM (
  SELECT event_id, CAST(ts AS DATE) AS edition_date, ts AS moment FROM events WHERE event_type <> 'error') e
JOIN LATERAL (SELECT nullif(count(*), 0) AS n FROM versions v WHERE v.edition_date = e.edition_date AND v.generated_at <= e.moment) ON true
LEFT JOIN (SELECT edition_date, event_id, row_number() OVER (PARTITION BY edition_date ORDER BY generated_at, event_id) AS version FROM versions) i
  ON i.edition_date = e.edition_date AND i.version = n
""", ("versions",))
def edition_as_of(spark, sf):
    """The version of its day's edition that each event of another kind met."""
    events = v.table(spark, sf, "events").where(F.col("event_type") != "error")
    moments = events.select(F.col("ts").cast("date").alias("edition_date"), F.col("ts").alias("moment"), F.col("event_id").alias("asked"))
    met = audit.edition_as_of(audit.version_intervals(v.generations(spark, sf)), moments)
    return met.select("asked", "moment", F.col("version").cast("bigint").alias("version"), "event_id")


@query("date_label_es", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN concat('sin fecha ', event_id) ELSE concat(
  ['domingo','lunes','martes','miércoles','jueves','viernes','sábado'][dayofweek(ts) + 1], ', ', day(ts), ' de ',
  ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][month(ts)], ' de ', year(ts)) END AS label
FROM events
""")
def date_label(spark, sf):
    raw = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("sin fecha "), F.col("event_id").cast("string"))).otherwise(
        F.col("ts").cast("date").cast("string")
    )
    return v.table(spark, sf, "events").select("event_id", date_label_es(raw).alias("label"))


@query("client_key", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('10.0.0.', user_id % 250) WHEN event_id % 3 = 1 THEN concat('10.1.0.', user_id % 250)
  ELSE concat('2001:db8::', user_id) END AS client FROM events
""")
def client_key_query(spark, sf):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    tail = (F.col("user_id") % 250).cast("string")
    forwarded = F.when(k == 0, F.concat(F.lit("1.2.3.4, spoofed , 10.0.0."), tail, F.lit(" "))).when(k == 1, F.lit(" "))
    peer = F.when(k == 2, F.concat(F.lit("[2001:db8::"), u, F.lit("]:443"))).otherwise(F.concat(F.lit("10.1.0."), tail, F.lit(":8080")))
    return v.table(spark, sf, "events").select("event_id", client_key(forwarded, peer).alias("client"))


@query("normalize_email", """
SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN concat(lower(replace(c_name, '#', '.')), '@mail.example') END AS email FROM customer
""")
def normalize_email_query(spark, sf):
    name, k = F.replace("c_name", F.lit("#"), F.lit(".")), F.col("c_custkey") % 4
    s = lambda *p: F.concat(*p)
    raw = (
        F.when(k == 0, s(F.lit("  "), name, F.lit("@Mail.Example \t"))).when(k == 1, s(name, F.lit("@mail.example")))
        .when(k == 2, s(name, F.lit("@@mail.example"))).otherwise(s(F.lit("Ana <"), name, F.lit("@mail.example>")))
    )
    return v.table(spark, sf, "customer").select("c_custkey", normalize_email(raw).alias("email"))


_BUCKET = f"""
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) AS client, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
st AS (
  SELECT client, event_id, us, rn, true AS admitted, CAST({RATE.full - RATE.one} AS BIGINT) AS tokens FROM ev WHERE rn = 1
  UNION ALL
  SELECT client, event_id, us, rn, held >= {RATE.one}, CASE WHEN held >= {RATE.one} THEN held - {RATE.one} ELSE held END
  FROM (SELECT e.client, e.event_id, e.us, e.rn, least({RATE.full}, s.tokens + (e.us - s.us) * {RATE.count}) AS held
        FROM st s JOIN ev e ON e.client = s.client AND e.rn = s.rn + 1))
"""


@query("token_bucket", _BUCKET + "SELECT client, event_id, us, admitted, tokens FROM st")
def token_bucket(spark, sf):
    return admission.admit(v.client_requests(spark, sf), RATE)


@query("token_bucket_busy", _BUCKET + "SELECT client, event_id, us, admitted, tokens FROM st")
def token_bucket_busy(spark, sf):
    """The way of busy clients for all of them: chunks, their transfer functions, and a replay of all chunks side by side."""
    return admission.admit(v.client_requests(spark, sf), RATE, small=0, chunk_rows=512)


@query("bucket_sweep", _BUCKET + f"""
SELECT client, tokens, us AS last_us, tokens + (epoch_us(TIMESTAMP '{v.NOW}') - us) * {RATE.count} >= {RATE.full} AS swept
FROM st QUALIFY rn = max(rn) OVER (PARTITION BY client)
""")
def bucket_sweep(spark, sf):
    decisions = admission.admit(v.client_requests(spark, sf), RATE)
    return admission.bucket_sweep(decisions, RATE, epoch_us(v.now()))


@query("bucket_refills", _BUCKET + f"""
SELECT client, tokens, us AS last_us, refilled_us FROM (
  SELECT client, tokens, us, lead(us) OVER (PARTITION BY client ORDER BY event_id) AS next_us,
    us + ({RATE.full} - tokens + {RATE.count - 1}) // {RATE.count} AS refilled_us FROM st)
WHERE refilled_us <= coalesce(next_us, epoch_us(TIMESTAMP '{v.NOW}'))
""")
def bucket_refills(spark, sf):
    return admission.refills(admission.admit(v.client_requests(spark, sf), RATE), RATE, epoch_us(v.now()))


_RESEND, _TTL = RULES.resend_seconds * 1_000_000, RULES.ttl_seconds * 1_000_000
_LIFE = f"""
WITH RECURSIVE ev AS (
  SELECT user_id AS subscriber, event_id, epoch_us(ts) AS us,
    CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'unsubscribe' ELSE 'purge' END AS action,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events WHERE event_type <> 'purchase'),
st AS (
  SELECT DISTINCT subscriber, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS us, '' AS action, CAST(0 AS BIGINT) AS rn, '' AS outcome,
    false AS present, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS s FROM ev
  UNION ALL
  SELECT subscriber, event_id, us, action, rn, outcome,
    CASE outcome WHEN 'needs_confirmation' THEN true WHEN 'purged' THEN false ELSE present END,
    CASE WHEN outcome IN ('needs_confirmation', 'purged') THEN NULL WHEN outcome = 'confirmed' THEN us ELSE c END,
    CASE WHEN outcome IN ('needs_confirmation', 'confirmed', 'purged') THEN NULL WHEN outcome = 'unsubscribed' THEN us ELSE u END,
    CASE WHEN outcome = 'needs_confirmation' THEN us WHEN outcome = 'purged' THEN NULL ELSE s END
  FROM (SELECT e.*, p.present, p.c, p.u, p.s, CASE e.action
      WHEN 'subscribe' THEN CASE WHEN p.present AND p.c IS NOT NULL AND p.u IS NULL THEN 'already_active'
        WHEN p.present AND p.s >= e.us - {_RESEND} THEN 'throttled' ELSE 'needs_confirmation' END
      WHEN 'confirm' THEN CASE WHEN p.present AND p.c IS NULL AND p.s > e.us - {_TTL} THEN 'confirmed' ELSE 'confirm_failed' END
      WHEN 'unsubscribe' THEN CASE WHEN p.present AND p.u IS NULL THEN 'unsubscribed' ELSE 'unchanged' END
      ELSE CASE WHEN p.present AND p.c IS NULL AND p.s < e.us - {_TTL} THEN 'purged' ELSE 'kept' END END AS outcome
    FROM st p JOIN ev e ON e.subscriber = p.subscriber AND e.rn = p.rn + 1)),
final AS (SELECT subscriber, first_value(event_id) OVER w AS id, present, c, u, s, rn = max(rn) OVER (PARTITION BY subscriber) AS is_last
  FROM st WHERE rn > 0 WINDOW w AS (PARTITION BY subscriber ORDER BY rn))
"""


def lifecycle(spark, sf):
    return subscribers.optin_lifecycle(v.subscription_events(spark, sf), RULES)


@query("optin_lifecycle", _LIFE + """
SELECT subscriber, event_id, us, action, outcome, present, c AS confirmed_at, u AS unsubscribed_at, s AS sent_at FROM st WHERE rn > 0
""")
def optin_lifecycle(spark, sf):
    return lifecycle(spark, sf).select("subscriber", "event_id", "us", "action", "outcome", "state.*")


@query("optin_busy", _LIFE + """
SELECT subscriber, event_id, us, action, outcome, present, c AS confirmed_at, u AS unsubscribed_at, s AS sent_at FROM st WHERE rn > 0
""")
def optin_busy(spark, sf):
    """The way of busy subscribers for all of them: transfers of chunks, composed, and a replay of all chunks side by side."""
    rows = subscribers.optin_lifecycle(v.subscription_events(spark, sf), RULES, small=0, chunk_events=256, group_chunks=8)
    return rows.select("subscriber", "event_id", "us", "action", "outcome", "state.*")


@query("active_subscribers", _LIFE + """
SELECT id, subscriber, c AS confirmed_at, u AS unsubscribed_at, s AS sent_at FROM final WHERE is_last AND present AND c IS NOT NULL AND u IS NULL
""")
def active_subscribers(spark, sf):
    return subscribers.active_subscribers(subscribers.subscriber_states(lifecycle(spark, sf)))


@query("confirmations_since", _LIFE + f"""
SELECT count(*) FILTER (s > epoch_us(TIMESTAMP '{v.NOW}') - 86400000000) AS sent,
  count(*) FILTER (s > epoch_us(TIMESTAMP '{v.NOW}') - 86400000000) >= 3 AS capped FROM final WHERE is_last AND present
""")
def confirmations_since(spark, sf):
    states = subscribers.subscriber_states(lifecycle(spark, sf))
    return subscribers.confirmations_since(states, epoch_us(v.now()), 86400, 3)


@query("signup_cap", """
SELECT event_id, ts, in_window, in_window - 1 >= 20 AS over_cap FROM (
  SELECT event_id, ts, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW) AS in_window
  FROM events WHERE event_type = 'signup')
""")
def signup_cap(spark, sf):
    sends = v.table(spark, sf, "events").where(F.col("event_type") == "signup")
    return signups.trailing_sends(sends, 24, 20)
