"""Line dedup by winnowing: runs of lines that occur earlier in the corpus are deleted, in DataFrame operations only.

A run counts if it has `WINDOW` lines or `WORDS` words; one long line is enough. Windows are the shortest runs that count: the one that starts at a
line, and the one that ends there. What a window is follows from its own lines, so a run that two places share has the same windows in both.
Of each window the line with the smallest hash is selected (the rightmost of equal ones): the selected positions are the fingerprints of a
document, fewer than its lines, and any shared run that counts has one in common. Positions are brought together by fingerprint, in an
aggregation that combines before the shuffle; those of lines selected at one position of the corpus only are out. Around the others a match is extended line by line in both
directions: windows that start at a line carry it on, windows that end at a line carry it back, as long as they have an earlier occurrence
(smaller id, or earlier in the same text). Each window is held against the first position of its lines only, which loses nothing: a line lies
in a run that occurs earlier and counts exactly if it lies in such a window. All lines of these windows go. Decisions are taken on the input.

A hot line or a large group of copies only adds to counts and minima, which are combined before the shuffle, and to joins on the side that
Spark splits; no group is gathered. Lines are told apart by two hashes of 64 bits each. Null or empty texts have one empty line and lose nothing. A
null id counts as the smallest. Rows with equal id and text are one document. Other columns are kept as they are. A text is split once; its
time is linear in its lines.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.binding import bind, let
from newslens.llm.common import documents, fresh, with_result
from newslens.session import staged

#: Lines, or words, that a repeated run has at least.
WINDOW, WORDS = 3, 8
SHIFT = 31
WORD = r"[^\x20\x09-\x0D]+"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc, part, l) with each line as two hashes h and g and its number of words n."""

    def line(x: Column) -> Column:
        return F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("line"), x).alias("g"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("n"))

    return bind(documents(docs), {"l": F.transform(lines_of(F.col("text")), line)}).select("doc", "part", "l")


def windows_of(lines: Column, window: int, words: int) -> Column:
    """Windows of a text as array of (start, size, fingerprint, line of the fingerprint, content)."""

    def counts(start: Column, size: int) -> Column:
        """Whether `size` lines from `start` on are the shortest run that counts, from their start on or from their end back."""
        n = [F.get(lines, start + i)["n"] for i in range(size)]
        total = reduce(add, n)  # null past the end of the text
        whole = total >= words if size < window else total.isNotNull()
        return whole & ((total - n[-1] < words) | (total - n[0] < words)) if size > 1 else whole

    def selected(start: Column, size: int, view: Column) -> Column:
        """The window of `size` lines, whose hashes `view` has, with its selected line."""
        hashes = F.transform(view, lambda x: x["h"])
        return let(F.array_min(hashes), lambda least: F.struct(
            start.alias("start"), F.lit(size).alias("size"), least.alias("fingerprint"),
            (start + size - F.array_position(F.reverse(hashes), least).cast("int")).alias("line"),
            F.xxhash64(F.lit("lines"), F.transform(view, lambda x: x["g"])).alias("content"),
        ))

    def window_at(start: Column, size: int) -> Column:
        return F.when(counts(start, size), let(F.slice(lines, start + 1, size), lambda view: selected(start, size, view)))

    def at(start: Column) -> Column:
        return F.array_compact(F.array(*[window_at(start, size) for size in range(1, window + 1)]))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), at))


def place(part: Column, line: Column) -> Column:
    """One number in the order of (checksum of the text, line), so that texts of one id stay apart."""
    return part * (1 << SHIFT) + line


def repeated_runs(docs: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """(doc, part, lines): the numbers of the lines to delete, for documents that have some."""
    found = hashed_lines(docs).select("doc", "part", F.explode(windows_of(F.col("l"), window, words)).alias("w"))
    # Written once: a few numbers for each window, which all that follows reads instead of the texts.
    each = staged(found.select(
        "doc", place(F.col("part"), F.col("w.start")).alias("place"), "w.size", "w.fingerprint", place(F.col("part"), F.col("w.line")).alias("spot"), "w.content"
    ))
    recurring = (
        each.groupBy("fingerprint")
        .agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("spot").alias("p0"), F.max("spot").alias("p1"))
        .where("d0 <> d1 or p0 <> p1")
        .select(F.col("fingerprint").alias("recurring"))
    )
    candidates = each.join(recurring, F.col("fingerprint") == F.col("recurring")).drop("recurring", "spot")
    first = (
        candidates.groupBy("fingerprint", "content")
        .agg(F.min("doc").alias("first_doc"), F.min_by("place", F.struct("doc", "place")).alias("first_place"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("fingerprint").alias("f"), F.col("content").alias("c"), "first_doc", "first_place")
    )
    later = candidates.join(first, (F.col("fingerprint") == F.col("f")) & (F.col("content") == F.col("c"))).where(
        "doc <> first_doc or place <> first_place"
    )
    matches = later.select(
        "doc", F.shiftright("place", SHIFT).alias("part"), F.col("place").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("start"), "size"
    )
    lines = F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("line")
    runs = matches.select("doc", "part", lines).groupBy("doc", "part").agg(F.collect_set("line").alias("lines"))
    return runs


def without(text: Column, gone: Column) -> Column:
    """A text without the lines whose numbers are given."""
    return let(lines_of(text), lambda lines: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"
    ))


def dedup_lines(docs: DataFrame, window: int = WINDOW, words: int = WORDS, removed: str | None = None) -> DataFrame:
    """`docs` with later repeated runs deleted from `text`, all rows kept; `removed` names an optional column with the number of lines."""
    (gone,) = fresh(docs, "gone")
    joined = with_result(docs, repeated_runs(docs, window, words), lines=gone)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(gone)))
    if removed:
        joined = joined.withColumn(removed, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return joined.withColumn("text", text).drop(gone)


SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
c AS (SELECT doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '{WORD}'))) AS c FROM d),
s AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS s, l, c FROM c),
w AS (SELECT doc_id, s, n, l[s : s + n - 1] AS v FROM s, (VALUES (1), (2), (3)) k(n) WHERE s + n - 1 <= len(l) AND CASE n
  WHEN 1 THEN c[s] >= {WORDS}
  WHEN 2 THEN c[s] + c[s + 1] >= {WORDS} AND (c[s] < {WORDS} OR c[s + 1] < {WORDS})
  ELSE c[s] + c[s + 1] < {WORDS} OR c[s + 1] + c[s + 2] < {WORDS} END),
r AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY v ORDER BY doc_id, s) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(s - 1, s - 1 + n)) AS i FROM r WHERE k > 1),
kept AS (SELECT doc_id, l, list_filter(range(0, len(l)), lambda i: NOT list_contains(coalesce(g, []), i)) AS k
  FROM d LEFT JOIN (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id) USING (doc_id))
SELECT doc_id, len(l) AS n_lines, len(l) - len(k) AS n_removed, sha256(array_to_string(list_transform(k, lambda i: l[i + 1]), chr(10))) AS kept_sha256
FROM kept
"""
