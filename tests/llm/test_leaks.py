"""Leaks that are easy to lose: of a large benchmark, of frequent words, and of long items."""

from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402

from newslens.llm import leaks  # noqa: E402


def found(spark, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in leaks.leak_report(cases.frame(spark, rows), benchmark).collect()}


def test_more_items_than_dimensions(spark):
    """Brute force finds every copy by its words; so must the search, however many items there are."""
    rng = random.Random(3)
    items = [(i, cases.prose(rng, 38)) for i in range(2000)]
    rows = [(i, f"{cases.prose(rng, 50)} {t} {cases.prose(rng, 50)}") for i, t in items]
    want = {(i, i) for i, _ in items}
    got = found(spark, rows, items)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_frequent_words_and_small_tables(spark):
    """Items whose words are in most documents, in a hot group and between rare words, and a table of two documents."""
    rng = random.Random(5)
    items = [(i, cases.prose(rng, 20)) for i in range(5)]
    hot = " ".join(t for _, t in items)

    def rare(n):
        return " ".join("".join(rng.choice("vwxyzqkj") + rng.choice("aeiou") for _ in range(5)) for _ in range(n))

    rows = [(i, hot if i % 3 == 0 else cases.prose(rng, 60)) for i in range(300)]
    rows += [(1000 + i, f"{rare(60)} {items[i % 5][1]} {rare(60)}") for i in range(20)]
    want = {(i, j) for i in range(0, 300, 3) for j in range(5)} | {(1000 + i, i % 5) for i in range(20)}
    assert found(spark, rows, items) == want
    assert found(spark, [(1, cases.prose(rng, 80)), (2, f"{cases.prose(rng, 40)} {items[0][1]}")], items) == {(2, 0)}


def test_long_items(spark):
    """Items of 400 words: as they are, and with a word put in after every second one."""
    rng = random.Random(8)
    items = [(i, cases.prose(rng, 400)) for i in range(20)] + [(50, cases.prose(rng, 20))]
    rows = [(100 + i, cases.prose(rng, 300)) for i in range(200)]
    want = set()
    for i, t in items[:20]:
        words = t.split(" ")
        wider = " ".join(" ".join([*words[k : k + 2], cases.word(rng)]) for k in range(0, len(words), 2))
        for doc, copy in ((1000 + i, t), (2000 + i, wider)):
            rows.append((doc, f"{cases.prose(rng, 90)} {copy} {cases.prose(rng, 90)}"))
            want.add((doc, i))
    assert found(spark, rows, items) == want
    assert [len(p) for p in leaks.pieces(["a"] * 40)] == [32, 24] and [len(p) for p in leaks.pieces(["a"])] == [1]


def test_latent_space_is_fitted_on_all_passages(spark):
    """Six words that one passage of 30,000 has each are dimensions of the space too."""
    import numpy as np
    from pyspark.sql import functions as F

    feature = F.when(F.col("id") % 5000 == 0, F.col("id") / 5000 + 1).otherwise(0).cast("int")
    rows = spark.range(30_000).select(F.col("id").alias("place"), F.array(feature).alias("features"), F.array(F.lit(1.0).cast("float")).alias("weights"))
    space = leaks.latent_space(rows, [(np.array([0]), np.array([1.0]))], 10, 7)
    assert np.allclose(np.linalg.norm(space, axis=1), [1] * 7 + [0] * 3, atol=0.01)


def test_products_of_passages(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(sorted(rng.choice(40, k, replace=False).tolist()), rng.random(k).tolist()) for k in rng.integers(0, 9, 1500).tolist()]
    dense = np.zeros((1500, 40))
    for i, (f, w) in enumerate(rows):
        dense[i, f] = w
    right = rng.standard_normal((40, 6))
    frame = spark.createDataFrame(rows, "features array<int>, weights array<float>")
    assert np.allclose(leaks.product(frame, right), dense.T @ (dense @ right), rtol=1e-4, atol=1e-3)


def test_words_are_cut_at_once(monkeypatch):
    """Latin-1 texts don't go through the pattern; the words are those that it finds."""
    rng = random.Random(2)
    chars = [*map(chr, range(256)), *"\u0130\u212a\u2014\u3042\U0001f600\u0301"]
    texts = ["".join(rng.choices(chars if n % 2 else chars[:256], k=rng.randrange(40))) for n in range(3000)]
    for t in texts:
        assert leaks.words_of(t) == leaks.WORD.findall(t.lower())
    monkeypatch.setattr(leaks, "WORD", None)
    assert leaks.words_of("\u00bfQu\u00e9 dijo \u00c9l_2,\u00a0\x85no?") == ["qu\u00e9", "dijo", "\u00e9l_2", "no"] and leaks.words_of(None) == []


def test_words_out_of_the_benchmark_take_no_call():
    known = {"uno": 0, "dos": 1}
    assert leaks.Passages(["Uno tres", "", "dos"], known, 2).at.tolist() == [0, 2, 1]
