"""Small tables with every odd case, and plain versions of what the operators do."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, doc string, part string, score string, bucket string, n string"
VOWELS, CONSONANTS = "aeiou", "bcdfglmnprst"


def word(rng: random.Random) -> str:
    return "".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 3)))


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = word(rng)
        out.append(w.capitalize() if i % 9 == 0 else w)
        out.append(".\n" if i % 23 == 22 else ". " if i % 9 == 8 else " ")
    return "".join(out).strip()


def odd_texts(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty and blank texts, a very long one, copies, near copies, shared passages, repeated rows and ids."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng, rng.choice([3, 30, 150, 300]))) for i in range(10, 30)]
    rows += [(i, base) for i in (40, 41, 42)]
    rows += [(50 + i, base.replace(" ", "  ", 1) + f" {word(rng)}") for i in range(4)]
    rows += [(60 + i, f"{prose(rng, 40)}\n{passage}\n{prose(rng, 40)}") for i in range(4)]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "one two"), (75, "one two"), (76, "\x00 \x1f ünï 漢字 😀")]
    rows += [(80, prose(rng, 12_000)), (81, "x" * 60_000)]
    rows += [(90, base), (90, base), (90, passage), (None, base), (None, None)]
    return rows


def frame(spark, rows):
    """The rows as `documents`, with further columns whose names could clash, shuffled over several partitions."""
    full = [(i, t, None, "src", None if t is None else len(t), "x", "y", "z", None, "b", "n") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]
