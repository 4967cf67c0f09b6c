"""Secrets made of letters only, with the dictionary of the corpus itself."""

from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402

from newslens.llm import secrets  # noqa: E402


def test_copies_of_a_secret_make_no_word(spark):
    """Exact copies and near copies of a text with a letters-only secret; words of the prose stay cheap."""
    rng = random.Random(4)
    held = f"{cases.prose(rng, 30)} pwd is qvhzkwnxtrbj"
    rows = [(i, held) for i in range(60)] + [(100 + i, f"{held} {cases.prose(rng, 2)} {i}") for i in range(60)]
    rows += [(300 + i, f"monkey {cases.prose(rng, 60)}") for i in range(60)] + [(400, "pwd is monkeymonkey"), (401, "db_pwd is qvhzkwnxtrbj"), (402, "my_login_name: abc")]
    got = {r.doc_id: r for r in secrets.scans(cases.frame(spark, rows)).collect()}
    assert all(got[i].n_guess == 1 for i in [*range(60), *range(100, 160), 401])
    assert got[400].n_guess == 0 and got[402].n_guess == 0


def test_words_are_counted_over_distinct_texts(spark):
    rows = [(i, "copied words") for i in range(9)] + [(20 + i, f"common thing {i} secret=zzzzzzzz") for i in range(3)]
    assert secrets.common_words(cases.frame(spark, rows)) == {"common": 1, "thing": 2}
