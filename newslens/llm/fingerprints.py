"""Document fingerprints by one-permutation MinHash, in a few bits per bin.

Each shingle (`WORDS` words, A-Z in lower case) is hashed once; the first bits of the hash choose one of `BINS` bins and each bin keeps its
smallest hash. An empty bin takes the value of the first occupied bin in a fixed random order of its own (optimal densification: two sets
with the same occupied bins take the same one, others as often as their likeness says). Of every bin the lowest `BITS` bits are kept. Two
different values agree in these by chance once in 2 ** BITS, which the likeness corrects.

Texts with fewer words than a shingle have their whole sequence as one. Null, empty and blank texts have the empty fingerprint, which is
like itself (1) and unlike any other (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm import hashing
from newslens.llm.common import BLOCK_CHARS, NO_ID, documents
from newslens.session import staged

WORDS = 5
BINS = 512
BITS = 4
FEW = 48
_NONE = np.uint64(2**64 - 1)
_rng = np.random.default_rng(512)
#: For each bin, the order in which it asks the others, and the rank of each of the others in that order.
ORDER = np.argsort(_rng.random((BINS, BINS)), axis=1)
RANK = np.argsort(ORDER, axis=1)


def densified(table: np.ndarray) -> np.ndarray:
    """Fills the empty bins of each row (texts x bins) that has an occupied one."""
    empty = table == _NONE
    out = table.copy()
    occupied = BINS - empty.sum(axis=1)
    for row in np.flatnonzero((occupied > 0) & (occupied < FEW)):
        full, bare = np.flatnonzero(~empty[row]), np.flatnonzero(empty[row])
        out[row, bare] = table[row, full[np.argmin(RANK[np.ix_(bare, full)], axis=1)]]
    rows, bins = np.nonzero(empty & (occupied >= FEW)[:, None])
    turn = 0
    while len(rows):
        asked = ORDER[bins, turn]
        hit = ~empty[rows, asked]
        out[rows[hit], bins[hit]] = table[rows[hit], asked[hit]]
        rows, bins = rows[~hit], bins[~hit]
        turn += 1
    return out


def packed(texts: list[str], words: int = WORDS) -> list[bytes]:
    """Fingerprints of texts: BINS * BITS / 8 bytes each, or none for a text without words."""
    h, owner = hashing.shingles(*hashing.word_hashes(texts, lower=True), words)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    table = np.full(len(texts) * BINS, _NONE, np.uint64)
    np.minimum.at(table, owner * BINS + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
    table = densified(table.reshape(len(texts), BINS))
    low = (table & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    pairs = low[:, ::2] << 4 | low[:, 1::2]
    some = np.bincount(owner, minlength=len(texts)) > 0
    return [p.tobytes() if s else b"" for p, s in zip(pairs, some, strict=True)]


def likeness(x: list[bytes], y: list[bytes]) -> list[float]:
    """Estimated Jaccard similarity of each pair of fingerprints."""
    out = [1.0 if a == b else 0.0 for a, b in zip(x, y, strict=True)]
    both = [i for i, (a, b) in enumerate(zip(x, y, strict=True)) if a and b]
    if both:
        u, v = (np.frombuffer(b"".join(s[i] for i in both), np.uint8).reshape(len(both), -1) for s in (x, y))
        odd = u ^ v
        agree = ((odd >> 4 == 0).sum(axis=1) + (odd & 15 == 0).sum(axis=1)) / BINS
        chance = 2.0**-BITS
        for i, p in zip(both, np.clip((agree - chance) / (1 - chance), 0, 1).tolist(), strict=True):
            out[i] = p
    return out


ROWS = "kind int, pid int, doc long, text string, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
DONE, FIRST, LAST = 0, 1, 2


def compared(docs: list[int], texts: list[str], following: list[str]) -> list[tuple]:
    """Result rows of documents and the texts that follow them."""
    cut = [len(t) // 4 for t in texts]
    edited = [t[: len(t) - q] + n[:q] for t, n, q in zip(texts, following, cut, strict=True)]
    own, changed, after = packed(texts), packed(edited), packed(following)
    digests = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    return [
        (DONE, None, *row)
        for row in zip(docs, [None] * len(docs), map(len, texts), digests, own, changed, likeness(own, changed), likeness(own, after), strict=True)
    ]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row of a sorted partition with the next one; the two ends of the partition are given out as they are."""
    pid, held, last = TaskContext.get().partitionId(), [], None
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if last is None:
                yield batch_of([(FIRST, pid, doc, text, *[None] * 6)])
            held.append((doc, text))
            last = (doc, text)
            size += len(text)
            if size > BLOCK_CHARS // 4 and len(held) > 1:
                ids, texts = zip(*held, strict=True)
                yield batch_of(compared(list(ids[:-1]), list(texts[:-1]), list(texts[1:])))
                held, size = [last], len(text)
    if last is not None:
        if len(held) > 1:
            ids, texts = zip(*held, strict=True)
            yield batch_of(compared(list(ids[:-1]), list(texts[:-1]), list(texts[1:])))
        yield batch_of([(LAST, pid, *last, *[None] * 6)])


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts, following = (batch.column(c).to_pylist() for c in ("doc", "text", "following"))
        yield batch_of(compared(docs, texts, following))


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edited text (its last quarter replaced by the start of the next document's text).

    The order is by id (null first), then by a checksum of the text; after the last document comes the first. Texts move once, into ranges
    of ids; what crosses the end of a range is paired afterwards, one row per partition. Repeated rows are separate documents.
    """
    spark = docs.sparkSession
    ordered = documents(docs).repartitionByRange("doc", "part").sortWithinPartitions("doc", "part").select("doc", "text")
    rows = staged(ordered.mapInArrow(chain, ROWS))
    pids = sorted(r["pid"] for r in rows.where(F.col("kind") == FIRST).select("pid").collect())  # one number per partition
    steps = spark.createDataFrame(list(zip(pids, pids[1:] + pids[:1], strict=True)), "last_pid int, first_pid int")
    last = rows.where(F.col("kind") == LAST).select("pid", "doc", "text")
    first = rows.where(F.col("kind") == FIRST).select(F.col("pid").alias("first_pid"), F.col("text").alias("following"))
    ends = last.join(steps, F.col("pid") == F.col("last_pid")).join(first, "first_pid").select("doc", "text", "following").mapInArrow(across, ROWS)
    out = rows.where(F.col("kind") == DONE).unionByName(ends)
    return out.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_chars", "edited_sha256",
        *[F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")], "near_edited", "near_next",
    )
