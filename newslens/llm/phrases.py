"""Repeated-phrase automata: passages that occur before are confirmed, compiled into Aho-Corasick automata, and found in every document.

A window is `window` consecutive words. Every window has an anchor: the run of `gram` words inside it with the smallest hash (the rightmost
of equal ones), so equal windows have equal anchors at equal distances. The windows that share an anchor position form its context.

1. Anchors that occur once in the corpus are dropped: counts are combined before the shuffle, then joined with the positions.
2. Contexts are reduced to their first place. Where an anchor has one context only, all its windows have that first place; where it has
   several, the windows of one copy of each context are compared by hash. Copies are never compared with one another.
3. Windows with an earlier place that follow one another in both texts make a passage, a candidate.
4. The words of the candidates are cut from their first documents, and each bucket of documents gets the candidates its documents may hold.
   A bucket's passages are compiled into one automaton over words (pyahocorasick) and all documents of the bucket stream through it.
   Only what the automaton finds, word by word, is removed: a hash collision can't remove a word.

Order is (doc_id, start); a null id counts as the smallest, texts that share an id are ordered by a checksum, rows with equal id and text are
one document. Null, empty and short texts have no window. A hot passage adds to counts and to joins on the side that Spark splits; no group
of copies is gathered. What one bucket holds is bounded by the words of its documents, since candidates are passages of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens.llm import hashing
from newslens.llm.common import BLOCK_CHARS, NO_ID, blocks, documents, settled

WINDOW = 20
GRAM = 5
SHIFT = 31
START = (1 << SHIFT) - 1
#: Recurring anchor positions (about one in eight words) of the documents that share an automaton, on average; this bounds its size.
BUCKET_ANCHORS = 30_000
NARROW = 31


def contexts(words: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor position: text number, first window (from the text's start), windows, hash of the anchor, hash of the context."""
    span = window - gram + 1
    n = len(words) - gram + 1
    empty = np.empty(0, np.int64)
    if n < span:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    runs = hashing.Runs(words)
    at = np.arange(n)
    grams = runs.hash(at, at + gram)
    low = np.uint64((1 << NARROW) - 1)
    key = (grams & ~low) | (low - at.astype(np.uint64))
    least, width = key, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    chosen = (low - (least & low)).astype(np.int64)
    start = np.arange(len(chosen))
    owner = np.searchsorted(bounds, start, side="right") - 1
    inside = start + window <= bounds[1:][np.minimum(owner, len(bounds) - 2)]
    start, chosen, owner = start[inside], chosen[inside], owner[inside]
    if not len(start):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    head = np.ones(len(start), dtype=bool)
    head[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(start)))
    begin, anchor = start[first], chosen[first]
    context = hashing.mixed(runs.hash(begin, begin + count - 1 + window) + (anchor - begin).astype(np.uint64))
    context = (context & ~np.uint64(31)) | count.astype(np.uint64)
    return owner[first], begin - bounds[:-1][owner[first]], count, grams[anchor], context


POSITIONS = "anchor long, context long, doc long, place long"


def positions(docs: DataFrame, window: int, gram: int, anchors_only: bool = False) -> DataFrame:
    """Every anchor position of the documents. The last five bits of a context are its number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc, part = (np.array(batch.column(c), dtype=np.int64) for c in ("doc", "part"))
            for a, b in blocks(texts):
                owner, begin, _, anchor, context = contexts(*hashing.word_hashes(texts[a:b]), window, gram)
                place = (part[a:b][owner] << SHIFT) + begin
                columns = [hashing.signed(anchor), hashing.signed(context), doc[a:b][owner], place][: 1 if anchors_only else 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in POSITIONS.split(", ")][: len(columns)])

    if not 1 <= window - gram + 1 <= 31:
        raise ValueError("a window must be at most 30 words longer than a gram")
    return documents(docs).mapInArrow(run, "anchor long" if anchors_only else POSITIONS)


WINDOWS = "anchor long, context long, i long, content long, first_doc long, first_place long, n long"


def window_hashes(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows of some contexts. `wanted`: doc, part and an array `at` of (place, anchor, context, n) of contexts to read there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, texts, wants = (batch.column(c).to_pylist() for c in ("doc", "text", "at"))
            for a, b in blocks(texts):
                words, bounds = hashing.word_hashes(texts[a:b])
                rows = [(docs_[a + i], bounds[i], w["place"], w["anchor"], w["context"], w["n"]) for i, at in enumerate(wants[a:b]) for w in at]
                doc, base, place, anchor, context, n = np.array(rows, dtype=np.int64).reshape(-1, 6).T
                first = base + (place & START)
                count = context & 31
                owner = np.repeat(np.arange(len(first)), count)
                i = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = first[owner] + i
                content = hashing.signed(hashing.Runs(words).hash(start, start + window))
                out = (anchor[owner], context[owner], i, content, doc[owner], place[owner] + i, n[owner])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in WINDOWS.split(", ")])

    rows = wanted.withColumnsRenamed({"doc": "d", "part": "p"})
    found = documents(docs).join(rows, (F.col("doc") == F.col("d")) & (F.col("part") == F.col("p")))
    return found.select("doc", "text", "at").mapInArrow(run, WINDOWS)


def runs_of(origins: Column) -> Column:
    """Windows (i, d, p) of a context, those that follow one another here and at their origin put together: (i, n, d, p)."""
    empty = F.array().cast("array<struct<i:bigint,n:bigint,d:bigint,p:bigint>>")

    def add(out: Column, o: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        more = (last.d == o.d) & (last.i + last.n == o.i) & (last.p + last.n == o.p)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last.i.alias("i"), (last.n + 1).alias("n"), last.d.alias("d"), last.p.alias("p"))))
        return F.when(F.coalesce(more, F.lit(False)), longer).otherwise(F.concat(out, F.array(F.struct(o.i.alias("i"), F.lit(1).cast("bigint").alias("n"), o.d.alias("d"), o.p.alias("p")))))

    return F.aggregate(F.array_sort(origins), empty, add)


def candidates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, int]:
    """(doc, place, words, first_doc, first_place) of passages with an earlier place, and the number of recurring anchor positions."""
    counts = positions(docs, window, gram, anchors_only=True).groupBy("anchor").agg(F.count("*").alias("n"))
    recurring = counts.where("n > 1").select(F.col("anchor").alias("recurring"))
    found = positions(docs, window, gram)
    found = settled(found.join(recurring, F.col("anchor") == F.col("recurring")).drop("recurring"))
    first = found.groupBy("anchor", "context").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n"))
    several = first.groupBy(F.col("anchor").alias("several")).agg(F.count("*").alias("contexts")).where("contexts > 1")
    known = settled(
        first.join(several, F.col("anchor") == F.col("several"), "left").select(
            "anchor", "context", F.col("first.doc").alias("first_doc"), F.col("first.place").alias("first_place"), "n", F.col("contexts").isNotNull().alias("mixed")
        )
    )
    unclear = known.where("mixed")
    wanted = settled(
        unclear.groupBy(F.col("first_doc").alias("doc"), F.shiftright("first_place", SHIFT).alias("part")).agg(
            F.collect_list(F.struct(F.col("first_place").alias("place"), "anchor", "context", "n")).alias("at")
        )
    )
    placed = settled(window_hashes(docs, wanted, window))
    earliest = placed.groupBy("anchor", "content").agg(F.min(F.struct("first_doc", "first_place")).alias("first"), F.sum("n").alias("total"))
    origin = placed.select("anchor", "context", "i", "content").join(earliest.where("total > 1"), ["anchor", "content"])
    split = origin.groupBy("anchor", "context").agg(
        F.collect_set(F.struct("i", F.col("first.first_doc").alias("d"), F.col("first.first_place").alias("p"))).alias("origins")
    )
    split = settled(split.select("anchor", "context", runs_of(F.col("origins")).alias("origins")))
    resolved = known.join(split, ["anchor", "context"], "left").where("mixed = false or origins is not null")
    count = F.col("context").bitwiseAND(31)
    pieces = F.when(~F.col("mixed"), F.array(F.struct(F.col("place").alias("s"), count.alias("n"), F.col("first_doc").alias("d"), F.col("first_place").alias("p"))))
    pieces = pieces.otherwise(F.transform("origins", lambda o: F.struct((F.col("place") + o.i).alias("s"), o.n.alias("n"), o.d.alias("d"), o.p.alias("p"))))
    later = (
        found.distinct()
        .join(resolved.select(F.col("anchor").alias("a"), F.col("context").alias("c"), "first_doc", "first_place", "mixed", "origins"), (F.col("anchor") == F.col("a")) & (F.col("context") == F.col("c")))
        .select("doc", F.explode(pieces).alias("x"))
        .select("doc", "x.*")
        .where("doc <> d or s <> p")
    )
    line = Window.partitionBy("doc", "d", "diagonal").orderBy("s")
    before = F.max(F.col("s") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        later.withColumn("diagonal", F.col("s") - F.col("p"))
        .withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1))
        .withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    )
    passages = islands.groupBy("doc", "d", "diagonal", "island").agg(F.min("s").alias("place"), F.min("p").alias("first_place"), F.max(F.col("s") + F.col("n")).alias("end"))
    return passages.select(
        "doc", "place", (F.col("end") - F.col("place") + (window - 1)).alias("words"), F.col("d").alias("first_doc"), "first_place"
    ), found.count()


def passages_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of passages, cut from their first documents: doc, place, words, text."""
    spots = settled(
        wanted.groupBy(F.col("first_doc").alias("d"), F.shiftright("first_place", SHIFT).alias("p")).agg(
            F.collect_set(F.struct(F.col("first_place").alias("place"), "words")).alias("at")
        )
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "at")), strict=True):
                words = text.encode().split()
                rows += [(doc, x["place"], x["words"], b" ".join(words[x["place"] & START :][: x["words"]]).decode()) for x in at]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=["doc", "place", "words", "text"]
            )

    found = documents(docs).join(spots, (F.col("doc") == F.col("d")) & (F.col("part") == F.col("p"))).select("doc", "text", "at")
    return found.mapInArrow(cut, "doc long, place long, words long, text string").distinct()


class Automaton:
    """The passages of one bucket, over numbered words."""

    def __init__(self):
        import ahocorasick

        self.words: dict[bytes, int] = {}
        self.passages: list[tuple[int, int, int]] = []
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.ready = False

    def add(self, doc: int, place: int, text: str) -> None:
        key = tuple(self.words.setdefault(w, len(self.words) + 1) for w in text.encode().split())
        if key and self.machine.add_word(key, len(self.passages)):
            self.passages.append((doc, place, len(key)))

    def strip(self, doc: int, place: int, text: str) -> tuple[int, int, bytes]:
        """Number of words, number of words removed, and the other words joined by a blank."""
        words = text.encode("utf-8", "surrogatepass").split()
        if not self.passages:
            return len(words), 0, b" ".join(words)
        if not self.ready:
            self.machine.make_automaton()
            self.ready = True
        number = self.words.get
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for end, at in self.machine.iter(tuple(number(w, 0) for w in words)):
            d, p, n = self.passages[at]
            start = end + 1 - n
            if d != doc or p != place + start:
                edge[start] += 1
                edge[end + 1] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
        return len(words), len(words) - len(kept), b" ".join(kept)


RESULT = "doc long, part long, n_words long, n_removed long, kept string"


def dedup_phrases(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """(doc, part, n_words, n_removed, kept) of each row: its words without those of a window that starts earlier elsewhere.

    With `digest`, `kept` is the SHA-256 of the kept words instead of the words.
    """
    found, anchors = candidates(docs, window, gram)
    found = settled(found)
    texts = settled(passages_of(docs, found.select("first_doc", "first_place", "words")))
    buckets = max(1, anchors // BUCKET_ANCHORS)

    def bucket(doc, part):  # noqa: ANN001, ANN202
        return F.pmod(F.xxhash64(doc, part), F.lit(buckets)).alias("bucket")

    need = found.select(bucket(F.col("doc"), F.shiftright("place", SHIFT)), "first_doc", "first_place", F.col("words").alias("n")).distinct()
    shards = need.join(texts, (F.col("first_doc") == F.col("doc")) & (F.col("first_place") == F.col("place")) & (F.col("n") == F.col("words")))
    shards = shards.select("bucket", F.lit(0).alias("kind"), "doc", "place", "text")
    body = documents(docs).select(bucket(F.col("doc"), F.col("part")), F.lit(1).alias("kind"), "doc", (F.col("part") * (1 << SHIFT)).alias("place"), "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, out, size = None, None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            columns = list(zip(*out, strict=True)) or [()] * 5
            out, size = [], 0
            types = [pa.int64()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

        for batch in batches:
            for where, kind, doc, place, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "doc", "place", "text")), strict=True):
                if where != current:
                    current, machine = where, Automaton()
                if kind == 0:
                    machine.add(doc, place, text)
                    continue
                n, removed, kept = machine.strip(doc, place, text)
                kept = hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")
                out.append((doc, place >> SHIFT, n, removed, kept))
                size += len(kept)
                if size > BLOCK_CHARS:
                    yield flush()
        yield flush()

    rows = shards.unionByName(body).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return rows.mapInArrow(stream, RESULT)


def digests(docs: DataFrame) -> DataFrame:
    kept = dedup_phrases(docs, digest=True)
    return kept.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(w) - {WINDOW - 1})) AS s, w FROM d),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY v ORDER BY doc_id, s) AS n
  FROM (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + {WINDOW}], ' ')) AS v FROM s)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS i FROM r WHERE n > 1),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
