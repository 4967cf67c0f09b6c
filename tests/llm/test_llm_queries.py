"""Registered queries against their SQL, and the pipeline against plain stages."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402
import compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from newslens.llm import queries as llm  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_matches_sql(spark, name):
    con = compare.connect(SF)
    df = llm.QUERIES[name](spark, SF)
    names, want = compare.duck_rows(con, llm.ORACLE[name])
    assert sorted(df.columns) == sorted(names)
    assert compare.spark_rows(df) == want


def test_one_query_for_each_operator():
    assert sorted({int(k[2:].split("_")[0]) for k in llm.QUERIES}) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    """Every stage on a small folder of tables: what goes, what stays, and the columns."""
    from test_duplicates import plain_components, repeated_lines

    import random

    rng = random.Random(21)
    item = cases.prose(rng, 40)
    rows = [(i, t) for i, t in cases.odd_texts() if i is not None and i != 90]
    rows += [(400 + i, cases.prose(rng, 60) + " vilegrub vilegrub") for i in range(20)]
    rows += [(500, f"{cases.prose(rng, 30)} {item} {cases.prose(rng, 30)}")]
    labels = [(i, int(i >= 400 and i < 420)) for i, _ in rows if i != 419]
    tables = {
        "documents": cases.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"),
        "labels": spark.createDataFrame(labels, "doc_id long, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    sf, docs, kept = str(tmp_path), tables["documents"], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == tables["documents"].columns
        path = str(tmp_path / f"out-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect() if r.text is not None) + [None] * docs.where("text is null").count()
    clean = [(i, t) for i, t in rows if not 400 <= i < 420]
    assert [x[0] for x in kept["toxicity"] if x] == sorted(i for i, t in clean if t is not None)
    gone = repeated_lines(clean)
    lines = sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(i, t)])) for i, t in clean if t is not None)
    assert [x[:2] for x in kept["line_dedup"] if x] == lines and all(x[2] == len(x[1]) for x in kept["line_dedup"] if x)
    one = sorted(i for i, _, c in plain_components(lines, 5, 80) if i == c)
    assert [x[0] for x in kept["jaccard_join"] if x] == one
    assert [x[0] for x in kept["decontamination"] if x] == [i for i in one if i != 500]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == {x[0] for x in kept["decontamination"] if x} | {70}
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(pieces)
