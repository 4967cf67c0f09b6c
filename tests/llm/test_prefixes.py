"""Token counts of prefixes against the library, which encodes each prefix anew."""

from __future__ import annotations

import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newslens.llm import prefixes
from newslens.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ALPHABETS = ["the ing tion er an re ", "'stremvld ' ", "0123 ", "éèÉ èö ", "ΣσΑ İıß ", "漢字 한한", "!!''.. --", "😀👍‍ \x85\xa0\x1c\x1d\x00 ", "aaaaabbbb", "ꟋꟜ\U00032808 a"]
WORDS = ["<|endoftext|>", "<|startoftext|>", "<|endof", "don't", "we'll", "'re", "THE", "\n\t", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lengths(library, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix(library):
    rng, known = random.Random(8), prefixes.counter(PATH)
    for _ in range(600):
        pick = [lambda: rng.choice(rng.choice(ALPHABETS)), lambda: rng.choice(WORDS + ALPHABETS)][rng.random() < 0.4]
        text = "".join(pick() for _ in range(rng.choice([0, 1, 4, 12])))
        got = np.cumsum(known.text(text), dtype=np.int64).tolist()
        assert got == lengths(library, [text[:i] for i in range(1, len(text) + 1)]), repr(text)


def test_single_characters(library):
    known = prefixes.counter(PATH)
    chars = [f"a{chr(c)}b" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert [int(known.text(c).sum(dtype=np.int64)) for c in chars] == lengths(library, chars)


def test_long_words(library):
    known, rng = prefixes.counter(PATH), random.Random(1)
    for text in ("x" * 100_000, "".join(rng.choice("abcdeist") for _ in range(100_000)), "ab " * 50_000, "漢" * 20_000, ""):
        assert int(known.text(text).sum(dtype=np.int64)) == lengths(library, [text])[0]


def test_steps_beyond_a_byte():
    for steps in ([], [1, 0, -1], [300, -300], [70_000], [2**40]):
        table = prefixes.packed(np.array(steps, np.int64))
        assert prefixes.unpacked(table).tolist() == np.cumsum([0, *steps]).tolist()


def test_tables_answer_questions(spark, library):
    rows = cases.odd_texts() + [(95, "a<|endoftext|>b we'll"), (96, "Été don't")]
    docs = cases.frame(spark, rows).withColumnRenamed("n", "n_tokens")
    tables = prefixes.with_prefixes(docs, PATH)
    assert tables.columns == [c for c in docs.columns if c != "n_tokens"] + ["n_tokens", "prefixes"]
    asked = tables.select("text", "n_tokens", prefixes.tokens_at(F.col("prefixes"), F.lit(30)).alias("at"), prefixes.longest_prefix(F.col("prefixes"), F.lit(25)).alias("longest")).collect()
    cut = prefixes.truncated(tables, 25).select("doc_id", "text").collect()
    assert len(asked) == len(cut) == len(rows)
    for r in asked:
        text = r.text or ""
        assert [r.n_tokens, r["at"]] == lengths(library, [text, text[:30]])
        fits = [i for i, n in enumerate(lengths(library, [text[:i] for i in range(min(len(text), 800) + 1)])) if n <= 25]
        assert r.longest == max(fits)
    kept = [r.text for r in cut if r.text]
    assert max(lengths(library, kept)) == 25
    assert sum(r.text is None for r in cut) == sum(t is None for _, t in rows)


def test_report(spark, library):
    rows = cases.odd_texts()
    got = prefixes.count_report(cases.frame(spark, rows), PATH, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    counts = lengths(library, [t or "" for _, t in rows])
    want = [(i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, counts, strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert prefixes.count_report(cases.frame(spark, rows).where("doc_id < 0"), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        prefixes.Counter(tokenizer_path("byte_bpe_50k.json"))
