"""Token counts of every prefix of a text, by prefix dynamic programming over its words.

A byte-pair encoding is right exactly where each two neighbouring tokens are the encoding of their two strings together. So the last token of
a prefix follows from shorter prefixes: it is the token that ends there and agrees with the last token of the prefix before it. One pass over a
word gives the last token and the number of tokens of each of its prefixes, and as words are encoded by themselves, the steps of the words laid
end to end are the steps of the text. `with_prefixes` keeps these steps; `tokens_at` and `truncated` then answer how many tokens a prefix has
and where a budget ends by adding steps up, without encoding again. Documents are handled inside their row and never move.

The counts are those of tokenizers for `encode(text[:i], add_special_tokens=False)`, for byte-level tokenizer files with word ends that compose,
lower-case and split as `Counter` states. Names of special tokens in a text count as one token each, which is that library's default.

Null and empty texts have no prefix and no tokens. Repeated rows, null ids and ties need no care: each row is answered by itself. An empty table
gives an empty one. Other columns of the input are kept; those named like a new column give way to it. The time is linear in the text, but for
a word of letters that are stored uncomposed, where it grows with the square of that word.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from newslens.llm.common import blocks
from newslens.llm.packing import byte_letters

#: Words that a worker remembers, and the longest of them. More are counted again.
WORDS, WORD_CHARS = 400_000, 64

# The published way in which this family of tokenizers splits a text, and the same for ASCII.
ENDINGS = r"'s|'t|'re|'ve|'m|'ll|'d"
PIECES = regex.compile(rf"\p{{White_Space}}+|{ENDINGS}|\p{{L}}+|\p{{N}}|[^\p{{White_Space}}\p{{L}}\p{{N}}]+")
#: From here on, character tables of Python and of the library may be of different years.
LATER = re.compile("[^\0-\u0557]")
PIECES_ASCII = re.compile(rf"[\x20\x09-\x0D]+|{ENDINGS}|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"
#: What a run of letters can be: a token inside a word, one at its end, or else only the start of one.
INSIDE, ENDING = 1, 2


class Steps(dict):
    """By piece of text, the change of the token count at each of its characters, in one byte each."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, piece: str) -> bytes:
        out = array("b", self.counter.steps(piece)).tobytes()
        if len(piece) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[piece] = out
        return out


class Counter:
    """Prefix counts under one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], json.dumps(spec["pre_tokenizer"])
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or json.dumps(SPLIT)[1:-1] not in split:
            raise ValueError(f"{path} is no byte-level tokenizer with word ends")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = ["".join(m) for m in merges]
        if len(set(made)) < len(made):
            raise ValueError("two merges make one token: prefixes do not determine its encoding")
        self.rank = {t: i for i, t in enumerate(made)}
        self.parts = dict(zip(made, merges, strict=True))
        self.letter = {b: c for c, b in byte_letters().items()}
        tokens = {t for t in model["vocab"] if t not in self.rank}
        for t in made:  # what other merges always forestall is no token of any text
            if tokens.issuperset(self.parts[t]) and self.agree(*self.parts[t], whole=t):
                tokens.add(t)
        self.kinds: dict[str, int] = {}
        for t in tokens:
            letters = t.removesuffix(WORD_END)
            for j in range(1, len(letters)):
                self.kinds.setdefault(letters[:j], 0)
            self.kinds[letters] = self.kinds.get(letters, 0) | (INSIDE if letters == t else ENDING)
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.agreed: dict[tuple[str, str], bool] = {}
        self.small = Steps(self)

    def agree(self, left: str, right: str, whole: str | None = None) -> bool:
        """Whether `left` and `right` stay apart when their strings are encoded together; with `whole`, whether nothing comes before that merge.

        The merges that made the two tokens are undone from the last on. If a merge across the border comes before the one undone (leftmost
        first where they are the same), it would have been taken.
        """
        limit = len(self.rank) if whole is None else self.rank[whole]
        while True:
            if self.rank.get(left + right, limit) < limit and self.parts[left + right] == (left, right):
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def follows(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) >= WORDS:
                self.agreed.clear()
            known = self.agreed[key] = self.agree(left, right)
        return known

    def word(self, letters: str) -> list[int]:
        """Number of tokens of each prefix of a word, in byte letters.

        Starts are taken from left to right, so the longest token that ends at a place is tried first there; exactly one agrees.
        """
        size, kinds, agreed = len(letters), self.kinds, self.agreed
        count, last, out = [0] * (size + 1), [""] * (size + 1), [0] * (size + 1)
        for k in range(size):
            before, tokens = last[k], count[k] + 1
            for j in range(k + 1, size + 1):
                token = letters[k:j]
                kind = kinds.get(token)
                if kind is None:
                    break
                if kind & INSIDE and not count[j] and (not k or (agreed.get((before, token)) or self.follows(before, token))):
                    count[j], last[j] = tokens, token
                if kind & ENDING and not out[j] and (not k or (agreed.get((before, end := token + WORD_END)) or self.follows(before, end))):
                    out[j] = tokens
        return out[1:]

    def counts(self, word: str) -> list[int]:
        """Number of tokens of each prefix of a word, in characters."""
        if word.isascii() and word.isprintable():
            return self.word(word)
        encoded = [c.encode() for c in word]
        found = self.word("".join(self.letter[b] for c in encoded for b in c))
        return [found[e - 1] for e in accumulate(map(len, encoded))]

    def steps(self, piece: str) -> list[int]:
        if piece.isspace() and not "\x1c" <= piece[0] <= "\x1f":
            return [0] * len(piece)
        found = self.counts(piece)
        if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():  # before its last letter, a mark and a word
            found[1] = found[0] + self.counts(piece[1])[0]
        return [b - a for a, b in zip([0, *found], found, strict=False)]

    def plain(self, text: str) -> np.ndarray:
        """Steps over text in the form that is split into words."""
        pieces = pieces_of(text)
        try:
            return np.frombuffer(b"".join(map(self.small.__getitem__, pieces)), np.int8)
        except OverflowError:
            return np.array([s for p in pieces for s in self.steps(p)], np.int32)

    def composed(self, text: str) -> np.ndarray:
        """Steps over text in composed form."""
        low = lower(text)
        if len(low) == len(text):
            return self.plain(low)
        ends = np.cumsum([len(lower(c)) for c in text])
        return np.diff(np.cumsum(self.plain(low), dtype=np.int64)[ends - 1], prepend=0)

    def uncomposed(self, text: str) -> np.ndarray:
        """Steps over text that changes as it is composed: a prefix may end between a letter and its marks."""
        starts = [i for i, c in enumerate(text) if i == 0 or not (unicodedata.combining(c) or c in composing())]
        groups = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        made = [lower(unicodedata.normalize("NFC", g)) for g in groups]
        whole = "".join(made)
        counts = np.concatenate([[0], np.cumsum(self.plain(whole), dtype=np.int64)])
        first = list(accumulate((len(p) for p in pieces_of(whole)), initial=0))
        out, at, piece = [], 0, 0
        for group, done in zip(groups, made, strict=True):
            while first[piece + 1] < at:
                piece += 1
            for i in range(1, len(group)):
                open_word = whole[first[piece] : at] + lower(unicodedata.normalize("NFC", group[:i]))
                out.append(counts[first[piece]] + self.plain(open_word).sum(dtype=np.int64))
            at += len(done)
            out.append(counts[at])
        return np.diff(out, prepend=0)

    def ordinary(self, text: str) -> np.ndarray:
        if text.isascii():
            return self.plain(text.lower())
        return self.composed(text) if unicodedata.is_normalized("NFC", text) else self.uncomposed(text)

    def text(self, text: str) -> np.ndarray:
        """Change of the token count at each character of a text."""
        out, at = [], 0
        for m in self.special.finditer(text):
            inner = self.ordinary(text[at : m.end() - 1])
            out += [inner, [1 - inner[m.start() - at :].sum(dtype=np.int64)]]
            at = m.end()
        rest = self.ordinary(text[at:])
        return np.concatenate([*out, rest]) if out else rest


def pieces_of(text: str) -> list[str]:
    """Runs of white space and words, which together are the text."""
    if text.isascii():
        return PIECES_ASCII.findall(text)
    return (tables().pieces if LATER.search(text) else PIECES).findall(text)


def lower(text: str) -> str:
    """Each character by itself: a sigma at the end of a word is no special case."""
    if not LATER.search(text):
        return text.replace("Σ", "σ").lower()
    known = tables()
    return known.changed.sub(lambda m: known.small[m[0]], text.replace("Σ", "σ")).lower()


class Tables:
    """Where the library's character tables and Python's differ: what a letter or a number is, and small forms."""

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.normalizers import Lowercase
        from tokenizers.pre_tokenizers import Split

        letters = [c for c in map(chr, range(128, 0x110000)) if not "\ud800" <= c <= "\udfff" and c != "Σ"]
        everything = "".join(letters)

        def odd(kind: str) -> str:
            theirs = {c for run, _ in Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(everything) for c in run}
            ours = {c for run in regex.findall(rf"\p{{{kind}}}+", everything) for c in run}
            plus, minus = ("".join(map(re.escape, sorted(x))) for x in (theirs - ours, ours - theirs))
            return rf"[\p{{{kind}}}{plus}--[{minus}]]" if minus else rf"[\p{{{kind}}}{plus}]"

        letter, number = odd("L"), odd("N")
        self.pieces = regex.compile(rf"\p{{White_Space}}+|{ENDINGS}|{letter}+|{number}|[^\p{{White_Space}}{letter}{number}]+", regex.V1)
        theirs = Lowercase().normalize_str("\n".join(letters)).split("\n")
        self.small = {c: t for c, t in zip(letters, theirs, strict=True) if c.lower() != t}
        self.changed = re.compile("[" + "".join(map(re.escape, self.small)) + "]" if self.small else r"(?!)")


@lru_cache(1)
def tables() -> Tables:
    return Tables()


@lru_cache(1)
def composing() -> frozenset[str]:
    """Characters that can join the one before them though they are no marks."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(seconds | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})


@lru_cache(4)
def counter(path: str) -> Counter:
    """The counter of a file, kept by a worker over its tasks."""
    return Counter(path)


def packed(steps: np.ndarray) -> bytes:
    """Bytes of a step, then the steps in the fewest bytes that hold them all."""
    low, high = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
    size = next(s for s in (1, 2, 4, 8) if -(1 << 8 * s - 1) <= low and high < 1 << 8 * s - 1)
    return bytes([size]) + steps.astype(f"<i{size}").tobytes()


def unpacked(table: bytes) -> np.ndarray:
    """Number of tokens of each prefix, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, f"<i{table[0]}", offset=1), dtype=np.int64)])


def with_prefixes(docs: DataFrame, tokenizer: str, text: str = "text", tokens: str = "n_tokens", prefixes: str | None = "prefixes", drop_text: bool = False) -> DataFrame:
    """Adds the number of tokens of each text and, unless `prefixes` is None, the table of its prefixes."""
    new = {tokens: "long"} | ({prefixes: "binary"} if prefixes else {})
    given = docs.drop(*new) if text not in new else docs
    kept = [f for f in given.schema.fields if not (drop_text and f.name == text)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` {t}" for n, t in new.items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(tokenizer)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            rest = batch.select([f.name for f in kept])
            for a, b in blocks([t or "" for t in texts]):
                steps = [known.text(t or "") for t in texts[a:b]]
                more = [pa.array([int(s.sum(dtype=np.int64)) for s in steps], pa.int64())]
                if prefixes:
                    more.append(pa.array([packed(s) for s in steps], pa.binary()))
                yield pa.RecordBatch.from_arrays(rest.slice(a, b - a).columns + more, names=[*rest.schema.names, *new])

    return given.mapInArrow(count, schema)


def _answers(fn):
    """A column function of a prefix table and a number; null where either is."""

    def run(tables: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or pd.isna(n) else int(fn(unpacked(t), int(n))) for t, n in zip(tables, numbers, strict=True)], dtype="Int64")

    return F.pandas_udf(run, LongType())


def tokens_at(prefixes: Column, chars: Column) -> Column:
    """Tokens of the prefix of so many characters (less than 0: none; more than there are: the whole text)."""
    return _answers(lambda counts, n: counts[min(max(n, 0), len(counts) - 1)])(prefixes, chars.cast("long"))


def longest_prefix(prefixes: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most `budget` tokens."""
    return _answers(lambda counts, n: np.flatnonzero(counts <= max(n, 0))[-1])(prefixes, budget.cast("long"))


def truncated(tables: DataFrame, budget: int, text: str = "text", prefixes: str = "prefixes") -> DataFrame:
    """Each text cut to its longest prefix of at most `budget` tokens."""
    return tables.withColumn(text, F.substring(F.col(text), F.lit(1), longest_prefix(F.col(prefixes), F.lit(budget)).cast("int")))


def count_report(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    out = with_prefixes(narrow, tokenizer, prefixes=None, drop_text=True)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
