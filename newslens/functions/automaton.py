"""Many terms sought in one pass over a text.

A shard of a dictionary becomes one automaton in each Python worker; a text is read once, whatever the number of terms. Workers get the terms as a
broadcast of a size that was checked when the shards were cut, and keep the automaton over their tasks.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick


class Finder:
    """Indices of the needles that occur in a text; needles may repeat, the empty one is never found."""

    def __init__(self, needles: list[str]):
        places: dict[str, list[int]] = {}
        for i, n in enumerate(needles):
            if n:
                places.setdefault(n, []).append(i)
        self.places = list(places.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, n in enumerate(places):
            self.automaton.add_word(n, k)
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[int]:
        if not text or not self.places:
            return []
        return [i for k in {k for _, k in self.automaton.iter(text)} for i in self.places[k]]


@lru_cache(2)
def finder(needles: tuple[str, ...]) -> Finder:
    """The automaton of these needles, kept by a worker over its tasks."""
    return Finder(list(needles))
