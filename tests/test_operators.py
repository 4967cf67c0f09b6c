import datetime
import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from newslens.operators import audit, coverage, evaluation, events, headlines, learning, scoring, signups, stories, tagging
from newslens.operators.components import components
from newslens.operators.numbering import cut_points, reached, sliced_row_number, sliced_running_sum
from newslens.session import staged

DAY = datetime.date(2026, 1, 1)


def skewed(spark, n=3000):
    """One group with most of the rows."""
    r = random.Random(7)
    rows = [(i, "hot" if r.random() < 0.8 else f"g{r.randrange(40)}", r.randrange(5)) for i in range(n)]
    return spark.createDataFrame(rows, "seq bigint, g string, w int")


def test_sliced_numbers_equal_a_window(spark):
    df = skewed(spark)
    for keys in ([("w", False), ("seq", True)], [("w", True), ("seq", False)], [("seq", True)]):
        order = [F.asc(c) if up else F.desc(c) for c, up in keys]
        got = sliced_row_number(df, ["g"], keys, "n", rows=64)
        want = df.withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
        assert got.join(want, ["seq"]).where("n <> m").count() == 0 and got.count() == df.count()
        few = sliced_row_number(df, ["g"], keys, "n", limit=10, rows=64)
        assert sorted(map(tuple, few.select("seq", "n").collect())) == sorted(map(tuple, want.where("m <= 10").select("seq", "m").collect()))


def test_slices_of_random_ids_are_even(spark):
    """Hashed 63-bit ids, one hot group, nulls in key and group: right numbers, and no slice with more than a few times its share."""
    r = random.Random(9)
    rows = [(r.getrandbits(63) - (1 << 62), "hot" if r.random() < 0.6 else None if r.random() < 0.2 else f"g{r.randrange(9)}") for _ in range(4000)]
    df = spark.createDataFrame([*rows, (None, "hot"), (None, None)], "id bigint, g string")
    got = sliced_row_number(df, ["g"], [("id", True)], "n", rows=100)
    want = df.withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    cuts = cut_points(df, ["id"], 100)["id"]
    sizes = [x["count"] for x in df.where("id is not null").groupBy(reached(F.col("id"), cuts).alias("s")).count().collect()]
    assert len(sizes) == 41 and max(sizes) < 200
    assert cut_points(df, ["id"], 10_000)["id"] == [] and cut_points(df.limit(0), ["id"], 10)["id"] == []


def test_reached_counts_cut_points(spark):
    for cuts in ([], [5], [1, 2], [-3, 0, 4], list(range(0, 70, 7))):
        values = [None, -100, 0, 1, 4, 5, 6, 7, 35, 63, 64, 1000]
        got = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", reached(F.col("v"), cuts).alias("r")).collect()
        assert {x.v: x.r for x in got} == {v: None if v is None else sum(c <= v for c in cuts) for v in values}


def test_sliced_sums_equal_a_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("g").orderBy("seq")
    for inclusive, end in ((True, 0), (False, -1)):
        got = sliced_running_sum(df, ["g"], [("seq", True)], F.col("w"), "s", inclusive, rows=50)
        want = df.withColumn("m", F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0)))
        assert got.join(want, "seq").where("s <> m").count() == 0


def test_trailing_sends(spark):
    start = datetime.datetime(2026, 1, 1)
    times = [0, 1, 2, 24, 25, 49]
    sends = spark.createDataFrame([(i, start + datetime.timedelta(hours=h)) for i, h in enumerate(times)], "event_id bigint, ts timestamp_ntz")
    got = signups.trailing_sends(sends, 24, 3).orderBy("event_id").collect()
    assert [r.in_window for r in got] == [1, 2, 3, 3, 3, 1] and [r.over_cap for r in got] == [False] * 6


def test_stale_and_cap(spark):
    now = datetime.datetime(2026, 9, 24)
    rows = [("a", 1, now - datetime.timedelta(hours=2)), ("a", 2, datetime.datetime(2020, 1, 1)), ("a", 3, None), ("a", 4, now + datetime.timedelta(days=9))]
    h = spark.createDataFrame(rows, "source_id string, feed_pos int, published_at timestamp_ntz")
    at = F.lit("2026-09-24 00:00:00").cast("timestamp_ntz")
    assert [r.feed_pos for r in headlines.drop_stale(h, at).orderBy("feed_pos").collect()] == [1, 3, 4]
    outlets = spark.createDataFrame([("a", "A")], "source_id string, name string")
    assert tuple(headlines.stale_by_source(h, outlets, at).first()) == ("A", 1)
    assert [r.feed_pos for r in headlines.cap_per_source(h, 2).orderBy("feed_pos").collect()] == [1, 2]


def test_prefilter(spark):
    gaz = {"countries": ["Chile", "Perú"], "companies": ["Vale"], "keywords": ["tariff"]}
    rows = [(1, "vale sube", ""), (2, "x", "TARIFF war"), (3, "Chile y PERÚ", ""), (4, "solo chile", ""), (5, "nada", "")]
    h = spark.createDataFrame(rows, "seq int, title string, snippet string")
    got = tagging.prefilter(h, gaz).orderBy("seq").collect()
    assert [r.passed for r in got] == [True, True, True, False, False]
    assert got[2].matched_countries == ["Chile", "Perú"]


def test_prefilter_by_automaton(spark):
    r = random.Random(4)
    word = lambda k: "".join(r.choice("abİé ") for _ in range(k))
    gaz = {k: [word(n) for n in (2, 3, 3, 4, 0, 2)] + ["aé"] for k in tagging.KINDS[:2]}
    rows = [(i, word(r.randrange(0, 30)), None if i % 9 == 0 else word(9)) for i in range(60)]
    h = spark.createDataFrame(rows, "seq int, title string, snippet string")
    few, many = (sorted(map(tuple, tagging.prefilter(h, gaz, few=n).collect())) for n in (99, 0))
    assert few == many and any(x[-1] for x in few)


def test_gazetteer_join_with_nulls_and_repeats(spark):
    notes = spark.createDataFrame([(1, "Abab"), (2, None), (3, ""), (None, "b")], "k int, t string")
    terms = spark.createDataFrame([("x", "A"), ("y", "a"), ("x", "A"), ("x", ""), ("x", None), (None, "BAB")], "kind string, term string")
    got = tagging.gazetteer_join(notes, terms, "k", F.col("t")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "x", "A"), (1, "x", "A"), (1, "y", "a"), (1, None, "BAB")]))


def test_gazetteer_join_matches_contains(spark):
    r = random.Random(3)
    word = lambda k: "".join(r.choice("abİé ") for _ in range(k))
    texts = [(i, word(r.randrange(0, 60))) for i in range(80)]
    words = sorted({word(k) for k in (1, 1, 2, 2, 3, 4, 5, 6) for _ in range(4)})
    notes, terms = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([("x", w) for w in words], "kind string, term string")
    low = lambda s: s.replace("İ", "i").lower()
    want = sorted((i, w) for i, t in texts for w in words if low(w) in low(t))
    for shard in (tagging.SHARD_BYTES, 40):
        got = tagging.gazetteer_join(notes, terms, "k", F.col("t"), shard)
        assert sorted((a.k, a.term) for a in got.collect()) == want
    assert tagging.gazetteer_join(notes, terms.limit(0), "k", F.col("t")).count() == 0


def test_gazetteer_join_reads_texts_in_a_bounded_number_of_passes(spark):
    terms = spark.createDataFrame([("x", f"word{i} ") for i in range(300)], "kind string, term string")
    notes = spark.createDataFrame([(1, "word7 word70 word299 "), (2, "word300 ")], "k int, t string")
    got = tagging.gazetteer_join(notes, terms, "k", F.col("t"), 16)
    assert sorted(map(tuple, got.collect())) == [(1, "x", "word299 "), (1, "x", "word7 "), (1, "x", "word70 ")]
    assert got._jdf.queryExecution().analyzed().toString().count("MapInArrow") <= tagging.MOST_PASSES


def note(seq, source, country, ownership="privado", companies=(), countries=(), relation="trade", title="t", snippet=""):
    return (seq, DAY, source, source.upper(), country, "europe", ownership, list(companies), list(countries), relation, title, snippet)


def voiced(spark, rows):
    schema = "seq bigint, edition_date date, source_id string, name string, country string, region string, ownership string, companies array<string>, countries array<string>, relation_type string, title string, snippet string"
    return stories.with_voices(spark.createDataFrame(rows, schema), F.concat_ws(" ", "title", "snippet"))


def test_stories_against_plain_sets(spark):
    r = random.Random(19)
    rows, plain = [], {}
    for i in range(1, 120):
        source, firms = r.choice("abcdefg"), r.sample(["Iota", "kappa", " LAMBDA "], r.choice([0, 0, 1, 2]))
        country, ownership = "UVW"["abcdefg".index(source) % 3], "estatal" if source in "ade" else "privado"
        places, wire = r.sample(["M", "n"], r.choice([0, 1])), r.choice([None, None, "Reuters", "EFE"])
        rows.append(note(i, source, country, ownership, firms, places, snippet=f"nota ({wire})" if wire else "nota"))
        names = lambda xs: "+".join(sorted({x.strip().lower() for x in xs}))
        key = f"company:{names(firms)}|trade" if firms else f"countries:{names(places)}|trade" if places else f"singleton:{i}"
        voice = f"w{wire}" if wire else f"s{country}" if ownership == "estatal" else source
        plain.setdefault(key, []).append((i, source, country, voice, wire))
    notes = voiced(spark, rows)
    got = {x.cluster_key: (x.notes, x.sources, x.countries, x.voices, x.voice_countries, x.weight) for x in stories.story_clusters(notes).collect()}
    want = {}
    for key, members in plain.items():
        sets = [len({m[k] for m in members}) for k in (1, 2, 3)]
        own = len({m[2] for m in members if m[4] is None})
        want[key] = (len(members), *sets, own, sets[2] + 2 * own)
    assert got == want
    told = {x.cluster_key: x.wires for x in stories.wire_summary(notes).collect()}
    for key, members in plain.items():
        wires = [m[4] for m in members if m[4]]
        assert told.get(key) == (", ".join(f"{w} en {wires.count(w)} medios" for w in sorted(set(wires))) or None)
    order = sorted(plain, key=lambda k: (-want[k][5], min(m[0] for m in plain[k])))
    cross = {x["rank"]: x.media_countries for x in stories.cross_coverage(notes).collect()}
    assert cross == {
        n: ", ".join(dict.fromkeys(m[2] for m in sorted(plain[k]))) for n, k in enumerate(order, 1) if want[k][1] > 1
    }


def test_group_assign_and_validate(spark):
    raw = spark.createDataFrame([([("e", [1, 2, 9]), ("f", [1, 4])],), ([],)], "g array<struct<event:string,items:array<int>>>")
    got = [r[0] for r in raw.select(stories.validate_groups(F.col("g"), F.lit(4))).collect()]
    assert [[(g["event"], g["items"]) for g in x] for x in got] == [[("e", [1, 2])], []]
    notes = voiced(spark, [note(1, "a", "X"), note(2, "b", "Y"), note(3, "c", "Z")])
    groups = spark.createDataFrame([(DAY, 1, 0, "ev"), (DAY, 2, 0, "ev")], "edition_date date, seq bigint, group_no int, event string")
    assert {r.seq: r.cluster_key for r in stories.group_assign(notes, groups).collect()} == {1: "group:0", 2: "group:0", 3: "singleton:3"}


def plain_events(rows, likeness):
    """seq -> smallest seq of its event, by all pairs of an edition."""
    words = {i: frozenset(t.lower().split()) - {"!!"} for _, i, t in rows}
    day = {i: d for d, i, _ in rows}
    root = {i: i for i in words}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in words:
        for j in words:
            if i < j and day[i] is not None and day[i] == day[j] and words[i] and len(words[i] & words[j]) >= likeness * len(words[i] | words[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    for i in words:  # rows without an edition are joined by equal words only
        for j in words:
            if i < j and day[i] is None and day[j] is None and words[i] and words[i] == words[j]:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in root}


def test_same_event_groups_against_all_pairs(spark):
    r = random.Random(5)
    hot = "el la de gobierno hoy".split()
    rare = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(240):
        kind = r.random()
        if kind < 0.3:  # a form with a number: all alike
            title = f"Resultado de la lotería {i}"
        elif kind < 0.6:  # frequent words with rare ones: in one bucket, mostly unlike
            title = " ".join(r.sample(hot, r.randint(1, 4)) + r.sample(rare, r.randint(0, 3)))
        else:
            title = " ".join(r.sample(rare[:25], r.randint(1, 6)))
        rows.append((r.choice([DAY, DAY, DAY, datetime.date(2026, 1, 2), None]), i, title))
    rows += [(DAY, 900, ""), (DAY, 901, "!!"), (DAY, 902, "uno"), (DAY, 903, "uno dos"), (DAY, 904, "UNO dos")]
    titles = spark.createDataFrame(rows, "edition_date date, seq bigint, title string").repartition(4)
    for likeness in (0.5, 0.7, 1 / 3):
        want = plain_events(rows, likeness)
        for large in (events.LARGE_BUCKET, 1):
            assert {x.seq: x.event_seq for x in events.same_event_groups(titles, likeness, large).collect()} == want
    assert events.same_event_groups(titles.limit(0)).count() == 0


def test_titles_of_a_large_bucket_meet_by_further_shared_words(spark):
    """Titles with one rare word in common and nothing else: their bucket is large, and no pair of them is formed."""
    r = random.Random(7)
    rows = [(DAY, i, " ".join(["el", *(f"q{r.randrange(400)}" for _ in range(r.randint(1, 5)))])) for i in range(150)]
    rows += [(DAY, 500 + i, f"dos palabras que todos llevan {i}") for i in range(30)] + [(DAY, 600 + i, f"raro {i} {i + 1000}") for i in range(90)]
    titles = spark.createDataFrame(rows, "edition_date date, seq bigint, title string").repartition(4)
    for likeness, large, deepest in ((0.5, 1, 2), (1 / 3, 2, 4)):
        assert {x.seq: x.event_seq for x in events.same_event_groups(titles, likeness, large, deepest).collect()} == plain_events(rows, likeness)
    words = spark.createDataFrame([(DAY, i, ["a", f"u{i}", f"v{i}", f"w{i}"]) for i in range(100)], "edition_date date, label bigint, w array<string>")
    ranked = staged(words.select("*", F.col("label").alias("id"), *events._bits(F.col("w"))))
    rooted = events._entries(ranked, 0.5).where("word = 'a'").withColumn("root", F.col("label"))
    # All meet by the one word that they share; what they share more decides, of which there is nothing.
    deeper = events._deeper(rooted, ranked, 0.5, 2)
    assert deeper.groupBy("edition_date", "word").count().where("count > 1").count() == 0
    assert events._links(rooted, ranked, 0.5, 8, 4).count() == 0


def test_unlike_titles_stay_apart_and_long_chains_close(spark):
    titles = spark.createDataFrame([(DAY, 1, "uno dos tres cuatro"), (DAY, 2, "uno otra cosa distinta aquí")], "edition_date date, seq bigint, title string")
    assert {x.seq: x.event_seq for x in events.same_event_groups(titles).collect()} == {1: 1, 2: 2}
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(9, 9)], "a bigint, b bigint")
    assert {x.node: x.root for x in components(chain).collect()} == dict.fromkeys(range(1, 151), 0)


def test_coverage(spark):
    outlets = spark.createDataFrame(
        [(f"s{i}", f"S{i}", "P", "europe", "oficialista" if i % 2 else "oposicion", i < 5) for i in range(6)],
        "source_id string, name string, country string, region string, stance string, has_feed boolean",
    )
    current = spark.createDataFrame([("s0",), ("s0",), ("s1",), ("s5",)], "source_id string")
    row = coverage.region_coverage(outlets, current).first()
    assert (row.configured, row.responded, row.low) == (5, 2, True)
    errors = spark.createDataFrame([("s1", "timeout")], "source_id string, detail string")
    status = coverage.source_status(outlets, current, errors)
    assert {r.source_id: r.status for r in status.collect()} == {"s0": "ok", "s1": "error", "s2": "sin_vigentes", "s3": "sin_vigentes", "s4": "sin_vigentes"}
    assert coverage.source_problems(status).count() == 4
    matrix = coverage.balance_matrix(outlets).first()
    assert (matrix.oficialista, matrix.oposicion, matrix.total, matrix.inactive, matrix.label) == (2, 3, 5, 1, "Europa")


def test_audit_counts(spark):
    stages = ["prefilter_rejected", "classifier_rejected", "classifier_error", "accepted", "accepted"]
    rows = spark.createDataFrame([(DAY, s) for s in stages], "edition_date date, stage string")
    assert tuple(audit.audit_counts(rows).first())[1:] == (5, 1, 1, 1, 2)


def test_versions_and_cost(spark):
    gens = spark.createDataFrame([(DAY, 1, None), (DAY, 2, "corrige"), (DAY, 3, ""), (datetime.date(2026, 1, 2), 4, "x")], "edition_date date, event_id bigint, reason string")
    v = audit.edition_versions(gens)
    assert [(r.version, r.reason) for r in v.orderBy("event_id").collect()] == [(1, audit.ORIGINAL_REASON), (2, "corrige"), (3, audit.UNSTATED_REASON), (1, audit.ORIGINAL_REASON)]
    assert [r.version for r in audit.latest_version(v).collect()] == [3] and audit.corrections(v).count() == 3
    usage = spark.createDataFrame([("r", "a", 1, 10, 1), ("r", "a", 2, 20, 1), ("r", None, 3, 5, 1)], "run string, stage string, cost int, prompt_tokens int, completion_tokens int")
    assert {r.stage: (r.requests, r.cost) for r in audit.cost_by_stage(usage).collect()} == {"a": (2, 3), "otros": (1, 3), None: (3, 6)}


def test_version_intervals_and_point_in_time_reads(spark):
    """Any moment meets the version that was public then; versions of one moment, moments before the first, unknown and null editions."""
    r = random.Random(10)
    start = datetime.datetime(2026, 1, 1)
    days = [DAY, datetime.date(2026, 1, 2), None]
    made = [(r.choice(days), i, start + datetime.timedelta(hours=r.randint(0, 60)), f"r{i}") for i in range(60)]
    gens = spark.createDataFrame(made, "edition_date date, event_id bigint, generated_at timestamp_ntz, reason string")
    asked = [(r.choice([*days, datetime.date(2030, 1, 1)]), start + datetime.timedelta(hours=h / 2), i) for i, h in enumerate(range(-4, 130))]
    moments = spark.createDataFrame(asked, "edition_date date, moment timestamp_ntz, id bigint")
    intervals = audit.version_intervals(gens)
    held = {}
    for day in days:
        mine = sorted((x for x in made if x[0] == day), key=lambda x: (x[2], x[1]))
        held[day] = [(i + 1, x[1], x[2], mine[i + 1][2] if i + 1 < len(mine) else None) for i, x in enumerate(mine)]
    got = {}
    for x in intervals.collect():
        got.setdefault(x.edition_date, []).append((x.version, x.event_id, x.valid_from, x.valid_to))
    assert {d: sorted(v) for d, v in got.items()} == held
    want = {}
    for day, moment, i in asked:
        public = [(v, e) for v, e, since, until in held.get(day, []) if since <= moment and (until is None or moment < until)]
        want[i] = public[0] if public else (None, None)
    assert {x.id: (x.version, x.event_id) for x in audit.edition_as_of(intervals, moments).collect()} == want


def test_observed_funnel_equals_the_counted_table(spark, tmp_path):
    stages = [audit.PREFILTER_REJECTED, audit.CLASSIFIER_REJECTED, audit.CLASSIFIER_ERROR, audit.ACCEPTED, audit.ACCEPTED]
    rows = spark.createDataFrame([(DAY, s, i) for i, s in enumerate(stages * 50)], "edition_date date, stage string, seq int").repartition(5)
    watched, funnel = audit.observed(rows)
    watched.write.parquet(str(tmp_path / "a"))
    counted = audit.audit_counts(spark.read.parquet(str(tmp_path / "a"))).drop("edition_date").first().asDict()
    assert funnel.get == counted == {"fetched": 250, "prefilter_rejected": 50, "classifier_rejected": 50, "classifier_errors": 50, "accepted": 100}


def test_cascade_ends_with_an_answer_or_the_last_error(spark):
    """Providers see only what is left; skipped items are sent once more alone; nothing is lost."""
    h = spark.createDataFrame([(i, DAY, "t" * (i + 1)) for i in range(40)], "seq bigint, edition_date date, title string")
    answer = lambda b: b[["seq"]].assign(size=b["title"].str.len())

    def first(batch):
        if len(batch) > 1 and 35 in set(batch["seq"]):
            raise TimeoutError("busy")
        return answer(batch[(batch["seq"] % 4 != 0) | ((len(batch) == 1) & (batch["seq"] % 8 == 0))]).iloc[::-1]

    def second(batch):
        raise ValueError("no key")

    def third(batch):
        if len(batch) == 1 and batch["seq"].iloc[0] == 36:
            raise ValueError("refused")
        return answer(batch[batch["seq"] % 12 != 0])

    run = lambda *chain: {r.seq: (r.provider_rank, r.attempts, r.status, r["size"], r.error) for r in scoring.score_cascade(h, list(chain), ["title"], "size bigint").collect()}
    got = run(first, second, third)
    want = {}
    for i in range(40):
        if i < 32:
            went = (1, 1) if i % 4 else (1, 2) if i % 8 == 0 else (3, 4) if i % 12 else (None, 5)
        else:
            went = (3, 3) if i % 12 else (None, 4)
        error = None if went[0] else "refused" if i == 36 else "no answer"
        want[i] = (*went, "ok" if went[0] else "error", i + 1 if went[0] else None, error)
    assert got == want
    assert {x[:3] for x in run(answer).values()} == {(1, 1, "ok")}
    assert {x[1:3] + x[4:] for x in run(second).values()} == {(1, "error", "no key")}
    assert scoring.score_cascade(h.limit(0), [answer], ["title"], "size bigint").count() == 0


def test_stored_pipeline(spark, tmp_path):
    """Fitted, stored, reloaded; better than chance on rows it has not seen, with the threshold that folds chose."""
    r = random.Random(2)
    words = lambda yes: " ".join(r.choice(["tratado", "comercio", "arancel"] if yes and r.random() < 0.4 else ["receta", "cocina", "sol", "mar"]) for _ in range(12))
    rows = [(i, words(i % 4 == 0), i % 4 == 0) for i in range(400)] + [(900, None, False), (901, "", False)]
    df = spark.createDataFrame(rows, "id bigint, text string, expected boolean")
    train, test = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    path = str(tmp_path / "model")
    learning.fit_pipeline(train).write().save(path)
    scores = {x.model: x for x in evaluation.prf1(evaluation.confusion(learning.predict_pipeline(path, test).unionByName(learning.predict(train, test)))).collect()}
    assert scores["pipeline"].f1 > 0.9 and set(scores) == {"pipeline", "learned"}
    probabilities = [(0.9, True), (0.8, False), (0.7, True), (0.2, False), (0.1, True)]
    best = learning.best_threshold(spark.createDataFrame(probabilities, "probability double, expected boolean"))

    def f1(t):
        said = [e for p, e in probabilities if p >= t]
        return 2 * sum(said) / (len(said) + 3)

    assert f1(best) == max(f1(k / 100) for k in range(100))


def test_evaluation(spark):
    p = spark.createDataFrame([("m", True, True, False), ("m", True, False, False), ("m", False, True, True), ("z", False, False, False)], "model string, predicted boolean, expected boolean, error boolean")
    rows = {r.model: r for r in evaluation.prf1(evaluation.confusion(p)).collect()}
    assert (rows["m"].precision, rows["m"].recall, rows["m"].errors, rows["z"].f1) == (0.5, 1.0, 1, 0.0)
    ex = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True)], "id int, expected boolean")
    votes = [(i, j, v) for i, vs in {1: "111", 2: "000", 3: "101", 4: "11"}.items() for j, v in zip("abc", [x == "1" for x in vs])]
    got = evaluation.label_consensus(ex, spark.createDataFrame(votes, "id int, judge string, vote boolean"), 3).orderBy("id").collect()
    assert [(r.outcome, r.label) for r in got] == [("confirmada", True), ("cambiada", False), ("sin_consenso", True), ("sin_consenso", True)]


def test_learned_scorer(spark):
    rows = [(i, "tratado comercio" if i % 2 else "receta cocina", i % 2 == 1) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, text string, expected boolean")
    assert learning.predict(df, df, held_out=True).where("expected <> predicted").count() == 0


def test_score_batches_keeps_every_row(spark):
    h = spark.createDataFrame([(i, DAY, "t" * i) for i in range(50)], "seq bigint, edition_date date, title string")
    seen = scoring.score_batches(scoring.batch_assign(h), lambda b: pd.DataFrame({"size": b["title"].str.len(), "n": len(b)}), ["title"], "size bigint, n bigint").collect()
    assert sorted(r.seq for r in seen) == list(range(50)) and all(r["size"] == r.seq for r in seen) and {r.n for r in seen} == {16, 2}
    short = scoring.score_batches(scoring.batch_assign(h), lambda b: b.head(1)[["title"]].rename(columns={"title": "x"}), ["title"], "x string")
    assert short.where("error is null").count() == 0 and short.count() == 50


def test_partition_count_does_not_matter(spark):
    df = skewed(spark, 500)
    run = lambda n: sorted(map(tuple, sliced_row_number(df.repartition(n), ["g"], [("seq", True)], rows=32).select("seq", "n").collect()))
    assert run(1) == run(8)
