import datetime
import random

from pyspark.sql import functions as F

from newslens.operators import admission, folds, subscribers, transitions
from newslens.streaming import admission as admission_stream
from newslens.streaming import feeds as feed_stream
from newslens.streaming import subscribers as subscriber_stream
from newslens.streaming.landing import Ingest, landing
from newslens.streaming.sources import drain, landed

START = datetime.datetime(2026, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def requests(spark, rows):
    return spark.createDataFrame([(c, at(s), i) for i, (c, s) in enumerate(rows)], "client string, ts timestamp_ntz, event_id bigint")


def test_buckets_against_a_plain_fold(spark):
    r = random.Random(23)
    t, rows = 0.0, []
    for _ in range(150):
        t += r.expovariate(1.5)
        rows.append((r.choice("pqr"), round(t, 3)))
    for rate in (admission.Rate(1, 2, 2), admission.Rate(5, 4, 3)):
        buckets, want = {}, []
        for client, s in rows:
            us = round(s * 1_000_000)
            tokens, last = buckets.get(client, (rate.burst * rate.per_seconds * 10**6, us))
            tokens = min(rate.burst * rate.per_seconds * 10**6, tokens + (us - last) * rate.count)
            ok = tokens >= rate.per_seconds * 10**6
            buckets[client] = (tokens - ok * rate.per_seconds * 10**6, us)
            want.append(ok)
        for small in (10**6, 0):
            got = admission.admit(requests(spark, rows), rate, small=small, chunk_rows=16).orderBy("event_id").collect()
            assert [x.admitted for x in got] == want


def test_busy_client_in_chunks_equals_one_pass(spark):
    r = random.Random(11)
    t, rows = 0, []
    for _ in range(400):
        t += r.choice([0, 0, 1, 2, 3, 5, 40]) * r.random()
        rows.append((r.choice(["hot"] * 8 + ["x", "y"]), t))
    for rate in (admission.Rate(1, 3, 3), admission.Rate(2, 7, 1), admission.Rate(3, 2, 5)):
        df = requests(spark, rows)
        whole = sorted(map(tuple, admission.admit(df, rate, small=10**6).collect()))
        parts = sorted(map(tuple, admission.admit(df, rate, small=5, chunk_rows=16).collect()))
        assert whole == parts


def test_chunks_grow_with_the_requests_not_with_how_clients_mix(spark):
    rows = [(f"c{i % 50}", i) for i in range(2000)]
    keyed = requests(spark, rows).select("client", "event_id", F.lit(0).alias("us"), F.lit(40).alias("_k"))
    sizes = [r["count"] for r in admission._chunks(keyed, 16).groupBy("client", "chunk").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) <= 50 * 3 and max(sizes) <= 32


def test_requests_without_a_time_find_a_full_bucket(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), None if r.random() < 0.1 else s) for s in range(1, 301)]
    df = spark.createDataFrame([(c, None if s is None else at(s), i) for i, (c, s) in enumerate(rows)], "client string, ts timestamp_ntz, event_id bigint")
    rate = admission.Rate(1, 3, 3)
    buckets, want = {}, []
    for client, s in rows:
        tokens, last = buckets.get(client, (rate.full, None))
        tokens = rate.full if s is None or last is None else min(rate.full, tokens + (s - last) * 10**6)
        buckets[client] = (tokens - (tokens >= rate.one) * rate.one, s)
        want.append((tokens >= rate.one, buckets[client][0]))
    got = admission.admit(df, rate, small=0).orderBy("event_id").collect()
    assert [(x.admitted, x.tokens) for x in got] == want


def test_groups_are_folded_as_one_stream(spark):
    rows = [(None if i % 7 == 0 else f"k{i % 7}", i) for i in range(120_000)] + [(f"one{i}", i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k string, n bigint")

    def ends(group):
        first = last = next(group)
        total = 1
        for last in group:
            total += 1
            assert last[1] > first[1]
        yield (first[0], first[1], last[1], total)

    got = folds.fold_groups(df, ["k"], ["n"], ends, "k string, lo bigint, hi bigint, total bigint").collect()
    want = df.groupBy("k").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("total")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) == 30_007


def test_transfer_function_is_exact():
    r = random.Random(2)
    rate = admission.Rate(2, 5, 4)
    for _ in range(50):
        t, us = 0, []
        for _ in range(r.randrange(1, 30)):
            t += r.randrange(0, 6_000_000)
            us.append(t)
        pieces = admission.transfer(us, rate)
        for held in [0, rate.full] + [r.randrange(rate.full) for _ in range(20)]:
            lo, slope, off = [p for p in pieces if p[0] <= held][-1]
            assert slope * held + off == admission.spend(us, held, us[0], rate)[2]


def test_bucket_sweep(spark):
    rate = admission.Rate(1, 1, 3)
    decided = admission.admit(requests(spark, [("a", 0), ("b", 9)]), rate)
    now = F.unix_micros(F.lit("2026-01-01 00:00:10+00:00").cast("timestamp"))
    assert {r.client: r.swept for r in admission.bucket_sweep(decided, rate, now).collect()} == {"a": True, "b": True}
    assert not admission.bucket_sweep(decided, admission.Rate(1, 100, 3), now).where("swept").count()


def subscription(spark, rows):
    return spark.createDataFrame([(k, at(s), i, a) for i, (k, s, a) in enumerate(rows)], "subscriber bigint, ts timestamp_ntz, event_id bigint, action string")


def random_subscriptions(spark, n=300):
    r = random.Random(4)
    t, rows = 0, []
    for _ in range(n):
        t += r.choice([5, 60, 3000, 40000, 300000])
        rows.append((r.choice([1, 1, 1, 1, 2, 3]), t, r.choice(["subscribe", "subscribe", "confirm", "unsubscribe", "purge"])))
    return subscription(spark, rows)


def plain_lifecycle(rows, rules):
    """Outcomes of (subscriber, us, action) in order, with one small record per subscriber."""
    people, out = {}, []
    for who, us, action in rows:
        p = people.get(who)
        waiting = p is not None and p["confirmed"] is None
        if action == "subscribe":
            if p and p["confirmed"] is not None and p["left"] is None:
                out.append("already_active")
            elif p and (p["sent"] or 0) >= us - rules.resend_seconds * 10**6:
                out.append("throttled")
            else:
                people[who] = {"confirmed": None, "left": None, "sent": us}
                out.append("needs_confirmation")
        elif action == "confirm":
            ok = waiting and p["sent"] is not None and p["sent"] > us - rules.ttl_seconds * 10**6
            if ok:
                p.update(confirmed=us, left=None)
            out.append("confirmed" if ok else "confirm_failed")
        elif action == "unsubscribe":
            ok = p is not None and p["left"] is None
            if ok:
                p["left"] = us
            out.append("unsubscribed" if ok else "unchanged")
        else:
            ok = waiting and p["sent"] is not None and p["sent"] < us - rules.ttl_seconds * 10**6
            if ok:
                del people[who]
            out.append("purged" if ok else "kept")
    return out


def test_lifecycle_against_a_plain_fold(spark):
    df, rules = random_subscriptions(spark, 200), subscribers.Rules(3600)
    rows = df.orderBy("event_id").collect()
    want = plain_lifecycle([(r.subscriber, (r.ts - START) // datetime.timedelta(microseconds=1) + 1_767_225_600_000_000, r.action) for r in rows], rules)
    assert len(set(want)) >= 7
    for small in (2048, 0):
        got = subscribers.optin_lifecycle(df, rules, small)
        assert [r.outcome for r in got.orderBy("event_id").collect()] == want


def test_busy_subscriber_in_chunks_equals_fold(spark):
    df, rules = random_subscriptions(spark), subscribers.Rules(3600)
    cols = ["subscriber", "event_id", "us", "action", "outcome", "state"]
    whole = sorted(map(tuple, subscribers.optin_lifecycle(df, rules).select(*cols).collect()))
    for small, chunk, group in ((100, 7, 3), (0, 16, 100), (0, 1, 2)):
        parts = subscribers.optin_lifecycle(df, rules, small, chunk, group)
        assert whole == sorted(map(tuple, parts.select(*cols).collect()))


def test_many_changes_of_one_subscriber_in_a_fixed_number_of_jobs(spark):
    """Thousands of changes of one key: as many jobs as a few changes take, and the outcomes of a plain fold."""
    def jobs(changes):
        rows = [(1, i * 7200, ("subscribe", "confirm", "unsubscribe")[i % 3]) for i in range(changes)]
        df, rules = subscription(spark, rows), subscribers.Rules(3600)
        sc = spark.sparkContext
        sc.setJobGroup(f"changes {changes}", "")
        try:
            got = subscribers.optin_lifecycle(df, rules, 100, 512, 4).orderBy("event_id").collect()
            n = len(sc.statusTracker().getJobIdsForGroup(f"changes {changes}"))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        plain = [(1, 1_767_225_600_000_000 + s * 10**6, a) for _, s, a in rows]
        assert [r.outcome for r in got] == plain_lifecycle(plain, rules)
        return n

    assert jobs(9000) == jobs(600)


def test_transfers_of_runs_compose():
    r = random.Random(12)
    for _ in range(120):
        rules, n, t, us = subscribers.Rules(r.choice([3, 10]), r.choice([5, 20])), r.randint(0, 60), 0, []
        for _ in range(n):
            t += r.choice([0, 1, 1, 2, 7, -3]) * 500_000
            us.append(t)
        actions = [r.choice(["subscribe", "subscribe", "confirm", "unsubscribe", "purge", "other"]) for _ in us]
        whole = transitions.Transfer.of(us, actions, rules, tidy=r.choice([1, 4, 128]))
        a, b = sorted((r.randint(0, n), r.randint(0, n)))
        parts = transitions.composed([transitions.Transfer.of(us[i:j], actions[i:j], rules) for i, j in ((0, a), (a, b), (b, n))])
        edges = [u - d * 10**6 + e for u in us[:6] for d in (3, 5, 10, 20) for e in (-1, 0, 1)]
        states = [None] + [(r.choice([None, 1, 5]), r.choice([None, 2, 9]), s) for s in [r.randint(-25_000_000, t + 5_000_000) for _ in range(20)] + edges]
        for state in states:
            want = state
            for x, action in zip(us, actions):
                want, _ = transitions.advance(want, action, x, rules)
            assert whole.apply(state) == parts.apply(state) == want


def files(spark, df, path, parts):
    """Rows as several files that land one after the other."""
    bounds = df.agg(F.max("event_id")).first()[0] // parts + 1
    for i in range(parts):
        df.where(F.floor(F.col("event_id") / bounds) == i).coalesce(1).write.mode("append").parquet(str(path))


def test_streams_equal_batches(spark, tmp_path):
    rate = admission.Rate(1, 3, 3)
    df = requests(spark, [("a" if i % 3 else "b", i) for i in range(60)])
    files(spark, df, tmp_path / "r", 3)
    stream = admission_stream.admit_stream(landed(spark, str(tmp_path / "r"), df.schema, files_per_batch=1), rate)
    assert sorted(map(tuple, drain(stream, "t").collect())) == sorted(map(tuple, admission.admit(df, rate).collect()))

    subs, rules = random_subscriptions(spark, 60), subscribers.Rules(3600)
    files(spark, subs, tmp_path / "s", 2)
    out = drain(subscriber_stream.optin_stream(landed(spark, str(tmp_path / "s"), subs.schema, files_per_batch=1), rules), "t")
    want = subscribers.optin_lifecycle(subs, rules).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_feed_stream_drops_repeats_and_old(spark, tmp_path):
    item = lambda t, d: f"<item><title>{t}</title><link>https://e.org/{t}</link><pubDate>{d}</pubDate></item>"
    body = lambda *items: bytearray(f"<rss><channel>{''.join(items)}</channel></rss>".encode())
    new, old = "Thu, 01 Jan 2026 00:00:00 GMT", "Wed, 01 Jan 2020 00:00:00 GMT"
    rows = [("s", at(60), body(item("a", new), item("b", old)), False), ("s", at(120), body(item("a", new), item("c", new)), False)]
    schema = "source_id string, fetched_at timestamp_ntz, body binary, rejected boolean"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    stream = feed_stream.feed_stream(landed(spark, str(tmp_path / "p"), schema, files_per_batch=1), F.lit("2026-01-01 01:00:00").cast("timestamp_ntz"))
    assert sorted(r.title for r in drain(stream, "t").collect()) == ["a", "c"]


def plain_refills(rows, rate, until):
    """(client, tokens, last, refilled) of (client, us) in order, by one bucket per client."""
    buckets, out = {}, []

    def full(client, tokens, last, before):
        refilled = last + -(-(rate.full - tokens) // rate.count)
        if refilled <= before:
            out.append((client, tokens, last, refilled))

    for client, us in rows:
        tokens, last = buckets.get(client, (rate.full, us))
        if client in buckets:
            full(client, tokens, last, us)
        tokens = min(rate.full, tokens + (us - last) * rate.count)
        buckets[client] = (tokens - rate.one if tokens >= rate.one else tokens, us)
    for client, (tokens, last) in buckets.items():
        full(client, tokens, last, until)
    return sorted(out)


def test_sweeps_of_a_stream_equal_the_batch(spark, tmp_path):
    """However the requests fall into batches, a full bucket is emitted once; the last ones by timers."""
    r, t, rows = random.Random(3), 0, []
    for _ in range(240):
        t += r.choice([0, 1, 2, 400, 9000])
        rows.append((r.choice("pqrs"), t))
    rows.append(("z", t + 30_000))
    rate, base = admission.Rate(2, 3600, 3), 1_767_225_600_000_000
    df = requests(spark, rows)
    until = base + (t + 30_000 - 3600) * 10**6
    want = plain_refills([(c, base + s * 10**6) for c, s in rows], rate, until)
    assert len(want) > 20 and "z" not in {w[0] for w in want}
    got = admission.refills(admission.admit(df, rate), rate, F.lit(until))
    assert sorted(map(tuple, got.collect())) == want
    for parts in (1, 5):
        folder = tmp_path / f"s{parts}"
        files(spark, df, folder, parts)
        out = drain(admission_stream.sweep_stream(landed(spark, str(folder), df.schema, files_per_batch=1), rate), "sweeps")
        assert sorted(map(tuple, out.collect())) == want


def test_landing_folder_restarts_and_reports_every_row(spark, tmp_path):
    """Three runs over one checkpoint: files are read once, late and repeated headlines are told, and a batch that runs again changes nothing."""
    item = lambda t, d, link=None: f"<item><title>{t}</title><link>{'' if link == '' else f'https://e.org/{t}'}</link><pubDate>{d}</pubDate></item>"
    body = lambda *items: bytearray(f"<rss><channel>{''.join(items)}</channel></rss>".encode())
    day = lambda n: f"{'Thu Fri Sat Sun Mon Tue Wed'.split()[(n - 1) % 7]}, {n:02} Jan 2026 00:00:00 GMT"
    schema = "source_id string, fetched_at timestamp_ntz, body binary, rejected boolean"
    folder, out = tmp_path / "landing", tmp_path / "out"
    ingest = Ingest(str(out), F.lit("2026-01-21 00:00:00").cast("timestamp_ntz"), None, 20 * 24)
    landings = [
        [("s", body(item("a", day(2)), item("a", day(2)), item("old", "Wed, 01 Jan 2020 00:00:00 GMT"), item("b", day(3), ""), item("b", day(3), "")))],
        [("s", body(item("a", day(2)), item("c", day(25)))), ("t", body(item("a", day(4))))],
        [("s", body(item("d", day(3)), item("c", day(25)), item("e", day(26)))), ("u", None)],
    ]
    stories = []
    for i, files_now in enumerate(landings):
        rows = [(s, at(60 * i), b, False) for s, b in files_now]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        (folder / ".half").write_text("not there yet")
        ingest.run(landing(spark, str(folder), schema))
        ingest.run(landing(spark, str(folder), schema))  # nothing new has landed
        stories.append(sorted((r.source_id, r.title, r.outcome, r.batch) for r in ingest.rows(spark).collect()))
    assert stories[0] == [("s", "a", "duplicate", 0), ("s", "a", "kept", 0), ("s", "b", "duplicate", 0), ("s", "b", "kept", 0), ("s", "old", "stale", 0)]
    assert [x for x in stories[1] if x[3] == 1] == [("s", "a", "duplicate", 1), ("s", "c", "kept", 1), ("t", "a", "kept", 1)]
    assert [x for x in stories[2] if x[3] == 2] == [("s", "c", "duplicate", 2), ("s", "d", "late", 2), ("s", "e", "kept", 2)]
    counts = {(r.source_id, r.outcome): r.rows for r in ingest.counts(spark).collect()}
    assert counts == {("s", "kept"): 4, ("s", "duplicate"): 4, ("s", "stale"): 1, ("s", "late"): 1, ("t", "kept"): 1}
    again = spark.read.schema(schema).parquet(*sorted(str(p) for p in folder.glob("*.parquet"))).where("source_id = 't' or fetched_at = timestamp_ntz'2026-01-01 00:01:00'")
    ingest.batch(again, 1)
    assert sorted((r.source_id, r.title, r.outcome, r.batch) for r in ingest.rows(spark).collect()) == stories[2]
