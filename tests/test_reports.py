import pytest
from pyspark.sql import functions as F

from newslens.functions import markdown as md
from newslens.operators import reports


def doc(spark, markdown):
    return spark.createDataFrame([(1, markdown)], "report_id int, markdown string").withColumn("edition_date", F.lit("2026-01-01").cast("date"))


def notes(spark, links):
    rows = [(i, f"s{i}", l, f"t{i}", "copete", f"Medio {i}", f"País {i % 3}", "estatal" if i % 2 else "", "") for i, l in enumerate(links, 1)]
    return spark.createDataFrame(
        rows, "seq bigint, source_id string, link string, title string, snippet string, name string, country string, ownership string, ownership_note string"
    ).withColumn("edition_date", F.lit("2026-01-01").cast("date"))


def random_report(rng, urls):
    """A report as a list of (section, kind, pieces); pieces are plain words, ("cite", numbers) or ("link", form, text, url)."""
    plan = []
    for section in rng.sample(["Resumen ejecutivo", "Resumen por región", "Clima internacional", "Otra"], rng.randint(1, 4)):
        for _ in range(rng.randint(1, 4)):
            pieces = []
            for _ in range(rng.randint(1, 6)):
                pick = rng.random()
                if pick < 0.3:
                    pieces.append(("cite", [rng.choice([1, 2, 3, 4, 77, 123456, 10**25]) for _ in range(rng.randint(1, 3))]))
                elif pick < 0.55:
                    pieces.append(("link", rng.choice(["named", "image", "angle", "bare"]), rng.choice("xyz") * 3, rng.choice([*urls, "https://elsewhere.test/q"])))
                else:
                    pieces.append(rng.choice(["sube", "baja!", "h<3", "pacto"]))
            plan.append((section, rng.choice(["- ", "* ", ""]), pieces))
    return plan


FORMS = {"named": "[{0}]({1})", "image": "![{0}]({1})", "angle": "<{1}>", "bare": "{1}"}


def write(plan, piece):
    """The Markdown of a plan; `piece` shows one piece. Sections are opened when they change."""
    out, now = [], None
    for section, bullet, pieces in plan:
        if section != now:
            out.append(f"## {section}\n")
            now = section
        out.append(bullet + " ".join(filter(None, map(piece, pieces))) + "\n")
    return "\n".join(out)


def shown(p):
    if isinstance(p, str):
        return p
    return "[" + ", ".join(map(str, p[1])) + "]" if p[0] == "cite" else FORMS[p[1]].format(p[2], p[3])


def test_random_reports_resolve_as_planned(spark):
    import random

    rng = random.Random(8)
    urls = ["https://n.test/1", "https://n.test/2", "", "https://n.test/4"]
    for _ in range(12):
        plan = random_report(rng, [])
        plan = [(s, b, [p for p in ps if p[0] != "link"] or ["nada"]) for s, b, ps in plan]
        good = bad = uncited = 0

        def resolved(p):
            nonlocal good, bad
            if isinstance(p, str):
                return p
            out = ""
            for n in p[1]:
                if n > len(urls):
                    bad += 1
                else:
                    good += 1
                    out += f"[[{n}]](<{urls[n - 1]}>)" if urls[n - 1] else f"[{n}]"
            return out

        lines = [(s, b, " ".join(filter(None, map(resolved, ps)))) for s, b, ps in plan]
        for section, bullet, line in lines:
            said = bullet + line
            if said.strip() and (bullet or section.startswith("Resumen")) and "[[" not in said:
                uncited += bool(bullet.strip()) and said.startswith(bullet) and bool(line) or bool(line) and section.startswith("Resumen")
        row = reports.resolve_citations(doc(spark, write(plan, shown)), notes(spark, urls)).first()
        assert (row.resolved, row.invalid) == (good, bad)
        squeeze = lambda t: " ".join(t.split())
        want = "\n".join(x for x in write([(s, b, [x]) for s, b, x in lines], str).split("\n"))
        assert squeeze(row.markdown) == squeeze(want)
        if all(line for _, _, line in lines):
            assert row.uncited == uncited


def test_numbers_beyond_ten_thousand(spark):
    many = [f"https://n.test/{i}" for i in range(1, 10_051)]
    row = reports.resolve_citations(doc(spark, "a [10050] b [10051] c [9, 10001]"), notes(spark, many)).first()
    assert (row.resolved, row.invalid) == (3, 1)
    assert row.markdown == "a [[10050]](<https://n.test/10050>) b  c [[9]](<https://n.test/9>)[[10001]](<https://n.test/10001>)"


def test_random_links_are_kept_or_dropped(spark):
    import random

    rng = random.Random(3)
    urls = ["https://n.test/1", "https://n.test/2"]
    for _ in range(12):
        plan = [(s, b, [p for p in ps if p[0] != "cite"] or ["nada"]) for s, b, ps in random_report(rng, urls)]
        gone = 0

        def kept(p):
            nonlocal gone
            if isinstance(p, str):
                return p
            _, form, text, url = p
            if url in urls and form != "image":
                return shown(p)
            gone += 1
            return text if form == "named" else ""

        want = write(plan, kept)
        row = reports.strip_unknown_links(doc(spark, write(plan, shown)), notes(spark, urls)).first()
        assert row.removed == gone and row.markdown.split() == want.split()


def test_claims_carry_their_notes(spark):
    import random

    rng = random.Random(14)
    urls = [f"https://n.test/{i}" for i in range(1, 6)]
    want, body = [], []
    for section in ("Resumen ejecutivo", "Mercados", "Noticias utilizadas"):
        body.append(f"## {section}")
        for i in range(4):
            nums = rng.sample(range(1, 6), rng.randint(0, 3))
            line = f"dato {section[0]}{i}"
            body.append(("- " if i % 2 else "") + line + "".join(f" [[{n}]](<{urls[n - 1]}>)" for n in nums))
            if nums and section != "Noticias utilizadas":
                want.append((section, line, nums))
    claims = reports.claim_batches(reports.claims(doc(spark, "\n\n".join(body))), 3)
    rows = claims.orderBy("claim_no").collect()
    assert [(r.section, " ".join(r.text.split()), r.nums) for r in rows] == want
    assert [(r.batch_no, r.id) for r in rows] == [(k // 3, k % 3 + 1) for k in range(len(want))]
    bundles = [r.evidence for r in reports.evidence_bundle(claims, notes(spark, urls)).orderBy("batch_no").collect()]
    for k, (section, line, nums) in enumerate(want):
        part = bundles[k // 3].split("AFIRMACIÓN ")[k % 3 + 1]
        assert part.startswith(f"{k % 3 + 1} (sección {section}):\n{line}") and [int(x.split("]")[0]) for x in part.split("Nota [")[1:]] == nums
    verdicts = spark.createDataFrame([(1, k // 3, k % 3 + 1, rng.choice(["respaldada", "inferencia", "dudosa"]), "", k) for k in range(len(want) - 1)],
                                     "report_id int, batch_no int, id int, verdict string, problem string, pos int")
    told = [r.verdict for r in verdicts.collect()]
    got = reports.fidelity_counts(reports.verdict_join(claims, verdicts)).first()
    assert tuple(got)[1:] == (len(told), told.count(reports.SUPPORTED), told.count(reports.INFERENCE), sum(x not in (reports.SUPPORTED, reports.INFERENCE) for x in told))


def test_sections(spark):
    text = "intro\n## A\n\na1\n\n## B\n### x\n1\n### y\n\n2\n## A\na2\n##no\n"
    got = [(r.heading, r.body) for r in reports.section_rows(doc(spark, text)).orderBy("section_no").collect()]
    assert got == [("A", "a1"), ("B", "### x\n1\n### y\n\n2"), ("A", "a2\n##no")]
    assert [r.body for r in reports.section_rows(doc(spark, text), "last").where("heading = 'A'").collect()] == ["a2\n##no"]
    assert [(r.heading, r.body) for r in reports.subsection_rows(doc(spark, text)).orderBy("sub_no").collect()] == [("x", "1"), ("y", "2")]


def test_abstract_and_headings(spark):
    split = lambda t: tuple(doc(spark, t).select(md.split_abstract(F.col("markdown")).alias("p")).select("p.*").first())
    assert split("\n## Resumen ejecutivo\n\nhola\n\n## B\nx") == ("hola", "## B\nx")
    assert split("## B\nx") == (None, "## B\nx")
    assert split("## Resumen ejecutivo\nsolo") == ("solo", "")
    fixed = doc(spark, "# Resumen ejecutivo\nx\n---\n# Otro\n # Clima internacional").select(md.normalize_headings(F.col("markdown"))).first()[0]
    assert fixed == "## Resumen ejecutivo\nx\n# Otro\n## Clima internacional"


def test_regions(spark):
    text = "## Resumen por región\n\n### Europa\n\nAlgo.\n\n### África\n\nSin novedades relevantes hoy.\n\n### Oceanía\n\nSin novedades relevantes hoy.\n\n## Clima internacional\n"
    rows = reports.split_regions(doc(spark, text)).orderBy("sub_no").collect()
    assert [(r.region, r.empty) for r in rows] == [("Europa", False), ("África", True), ("Oceanía", True)]
    cover = spark.createDataFrame([("eurasia", "Cobertura insuficiente hoy (0 de 3 medios respondieron).")], "region string, empty_text string").withColumn("edition_date", F.lit("2026-01-01").cast("date"))
    filled = reports.fill_missing_regions(doc(spark, text), cover)
    assert reports.missing_regions(doc(spark, text)).count() == 5 and reports.missing_regions(filled).count() == 0
    out = filled.first().markdown
    assert "### Eurasia\n\nCobertura insuficiente hoy (0 de 3 medios respondieron).\n" in out
    assert out.index("### Eurasia") < out.index("## Clima internacional")
    assert reports.fill_missing_regions(doc(spark, "nada"), cover).first().markdown == "nada"


def test_news_links(spark):
    text = "## A\n\n- [no](<https://n>) — O (P)\n\n## Noticias utilizadas\n\n### Europa\n\n- [Un \\[título\\] (x)](<https://e.org/1>) — Le M (Francia)\n- roto\n"
    row = reports.news_links(doc(spark, text)).collect()
    assert [(r.region, r.title, r.url, r.outlet, r.country) for r in row] == [("Europa", "Un [título] (x)", "https://e.org/1", "Le M", "Francia")]
    assert doc(spark, text).select(md.news_link_count(F.col("markdown"))).first()[0] == 1
