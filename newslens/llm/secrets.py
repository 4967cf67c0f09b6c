"""Secret scans: fixed patterns, and values in credential contexts that would take many guesses.

The guess cost of a value is the smallest sum of the costs of its parts over all ways to cut it: a word costs its rank in the dictionary
(with capitals and look-alike letters on top), a date its day and year, a repeat its unit and count, a keyboard walk its start, length and
turns, and anything else ten guesses per character. A dynamic program over the positions finds it. A value after a credential word, in
front of the host of an address, or after a bearer mark is a secret if it costs 10 ** `GUESSES` guesses or more; dictionary words are the
words that most distinct texts of the corpus itself hold, `TEXTS` at least, outside the values of credentials. So copies of a text, however
many, make no word of what it holds, and a secret makes no word of itself.

Null and empty texts have no span. Positions are code points, ends are exclusive. Repeated rows give equal results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import documents

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:orization)?|credentials?|login)(?![A-Za-z0-9])["']?\s*(?:\bis\b|:=|=>|[:=])\s*"""
    r"""["']?(?:bearer\s+|basic\s+)?|\bbearer\s+|--(?:password|token|secret)[ =]|://[^\s:/@]+:(?=[^\s/@]+@))([^\s"'<>,;@]{6,})""",
    re.I | re.A,
)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "auth", "credential", "login", "bearer", "://")
GUESSES = 8.0
DICTIONARY = 20_000
#: Distinct texts that a dictionary word is in.
TEXTS = 3
CACHE = 400_000
WORD = re.compile(r"[^\W\d_]{3,}")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/. ]?(?:0?[1-9]|1[0-2])[-/. ]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/. ]?(?:0?[1-9]|1[0-2])[-/. ]?(?:(?:19|20)?\d\d)|(?:19|20)\d\d)")
REPEAT = re.compile(r"(.+?)\1+", re.S)
# The rows of a keyboard, shifted by half a key each.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
KEYS = {c: (x + y / 2, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
LOOKALIKE = str.maketrans("0134578@$!", "oleastbasi")
PART = math.log10(2)


def near_keys(a: str, b: str) -> bool:
    if a not in KEYS or b not in KEYS or a == b:
        return False
    (x, y), (u, v) = KEYS[a], KEYS[b]
    return abs(y - v) <= 1 and abs(x - u) <= 1


def walks(value: str) -> Iterator[tuple[int, int, float]]:
    """Longest runs of neighbouring keys or of letters in alphabetic order, three characters or more."""
    low = value.lower()
    for step, cost in ((near_keys, 1.0), (lambda a, b: abs(ord(a) - ord(b)) == 1, 0.3)):
        start = 0
        for i in range(1, len(low) + 1):
            if i == len(low) or not step(low[i - 1], low[i]):
                if i - start >= 3:
                    yield start, i, math.log10(47 * (i - start)) + cost * 0.3 * (i - start)
                start = i


def word_cost(word: str, ranks: dict[str, int]) -> float | None:
    low = word.lower()
    for form, extra in ((low, 0.0), (low.translate(LOOKALIKE), math.log10(4))):
        if form in ranks:
            big = sum(c.isupper() for c in word)
            case = 0.0 if not big else math.log10(2) if big == len(word) or word[:1].isupper() and big == 1 else big * math.log10(2)
            return math.log10(ranks[form] + 1) + case + extra
    return None


def guess_cost(value: str, ranks: dict[str, int], longest: int) -> float:
    """Decimal logarithm of the guesses that the cheapest way to build `value` takes."""
    n = len(value)
    parts: dict[int, list[tuple[int, float]]] = {}

    def part(start: int, end: int, cost: float) -> None:
        parts.setdefault(end, []).append((start, max(0.0, cost)))

    for m in DATE.finditer(value):
        part(m.start(), m.end(), math.log10(365 * 120) if m.end() - m.start() > 4 else math.log10(120))
    for m in REPEAT.finditer(value):
        unit = m.group(1)
        base = min(len(unit), word_cost(unit, ranks) or len(unit))
        part(m.start(), m.end(), base + math.log10((m.end() - m.start()) // len(unit)))
    for start, end, cost in walks(value):
        part(start, end, cost)
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = best[j - 1] + 1.0
        for i, cost in parts.get(j, ()):
            best[j] = min(best[j], best[i] + cost + PART * (i > 0))
        for i in range(max(0, j - longest), j - 2):
            if best[i] + PART < best[j] and (cost := word_cost(value[i:j], ranks)) is not None:
                best[j] = min(best[j], best[i] + cost + PART * (i > 0))
    return best[n]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def scan(text: str, ranks: dict[str, int], longest: int) -> tuple[list, list]:
    """Spans of the fixed patterns, and those with the guessed values that none of them covers."""
    low = text.lower()
    base = sorted(base_spans(text, low))
    more = []
    if any(h in low for h in CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            if not any(s <= start and end <= e for s, _, e in base) and guess_cost(m.group(1), ranks, longest) >= GUESSES:
                more.append((start, 3, end))
    return base, sorted(base + more)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def plain_words(text: str) -> set[str]:
    """Distinct words of a text outside what the fixed patterns and the credential contexts take for values."""
    low = text.lower()
    spans = [(s, e) for s, _, e in base_spans(text, low)]
    if any(h in low for h in CONTEXT_HINTS):
        spans += [m.span(1) for m in CONTEXT.finditer(text)]
    at, kept = 0, []
    for start, end in sorted(spans):
        if start > at:
            kept.append(text[at:start])
        at = max(at, end)
    return set(WORD.findall(" ".join([*kept, text[at:]]).lower() if spans else low))


def common_words(docs: DataFrame, size: int = DICTIONARY, texts: int = TEXTS) -> dict[str, int]:
    """Rank of the `size` words that most distinct texts hold, `texts` at least; tasks add up their own counts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(plain_words(text))
                if len(seen) > CACHE:
                    yield flush()
        yield flush()

    distinct = documents(docs).select("text").distinct()
    counts = distinct.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= texts)
    return {r["word"]: i + 1 for i, r in enumerate(counts.orderBy(F.desc("n"), "word").limit(size).collect())}


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def scans(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """Counts and spans of each row. `ranks` is the dictionary (None: the words of `docs`, as `common_words` finds them)."""
    ranks = common_words(docs) if ranks is None else ranks
    longest = max(map(len, ranks), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = scan(text, ranks, longest)
                kinds = Counter(k for _, k, _ in spans)
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), kinds[3]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, RESULT)
