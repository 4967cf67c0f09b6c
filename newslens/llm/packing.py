"""Packing: documents are tokenized once, laid end to end, and cut into sequences of fixed length.

Two passes: each partition writes its token ids with the number of ids before each document *in that partition*; prefix sums over the
partition totals (one number per partition) turn these into global offsets; then every document is cut where a sequence ends, by itself.
No document is moved and no order is sorted. The ids are written to the shared folder, so the second pass meets the same partitions and
order even if executors are lost.

Null or empty text: one piece that holds the end id only. Null id: kept as null. Repeated rows are packed each. An empty table gives none.
Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import blocks
from newslens.session import run_dir

SEQUENCE = 1024


# Fixed value: the published pattern that splits a text before the merges of this family of byte-level tokenizers.
PIECES_OF_TEXT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids (little-endian, two bytes each where the vocabulary allows, else four) of texts by the byte-level BPE of a tokenizers file.

    Where the file's merges are in the order of their ids, its vocabulary is run as ranks, which gives the same ids several times faster;
    any other tokenizer is run as it is, and so is any text that holds the name of an added token, which then is that token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        self.fast = None
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        split = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space:
            self.fast = by_rank(path)

    def encode(self, text: str) -> bytes:
        fast = self.fast and not self.added.search(text)
        ids = self.fast.encode_ordinary(text) if fast else self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()


def id_kind(size: int) -> str:
    return "H" if size <= 1 << 16 else "I"


def by_rank(path: str):
    """The tokenizer of a file as a rank-based encoder, or None if its ids are not in the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab["".join(m)] for m in merges]
    if model.get("type") != "BPE" or model.get("dropout") or any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    shown = byte_letters()
    ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items() if all(c in shown for c in t) and (len(t) == 1 or i >= made[0])}
    return tiktoken.Encoding("ranks", pat_str=PIECES_OF_TEXT, mergeable_ranks={t: i for t, i in ranks.items() if i <= made[-1]}, special_tokens={})


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else the next from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


TOKENS = "part int, first long, doc_id long, n long, ids binary"
#: Bytes that a writing task gathers before it writes them.
ROW_GROUP = 1 << 24
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary string"


def tokens(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Token ids of every document with the partition it was in and the number of ids before it there; written to the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, encoder = TaskContext.get().partitionId(), 0, Encoder(tokenizer)
        width = array(encoder.kind).itemsize
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in blocks(texts):
                ids = [encoder.encode(t) + end for t in texts[a:b]]
                before = []
                for x in ids:
                    before.append(first)
                    first += len(x) // width
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(before, pa.int64()),
                        keys.slice(a, b - a),
                        pa.array([len(x) // width for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "first", "doc_id", "n", "ids"],
                )

    spark = docs.sparkSession
    path = run_dir(spark, "tokens")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    narrow.mapInArrow(encode, TOKENS).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(TOKENS).parquet(path)


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """One row per piece: where it lies in its document, and in which sequence at which offset.

    `boundary` tells whether a document is whole in its sequence or cut: head, middle, tail. Only the last sequence is shorter than `length`.
    """
    written = tokens(docs, tokenizer, end_id)
    totals = written.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per partition
    offsets, total = {}, 0
    for row in totals:
        offsets[row["part"]] = total
        total += row["n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, first, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, start = offsets[part] + first, 0
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                while start < n:
                    room = length - (at + start) % length
                    size = min(room, n - start)
                    last = start + size == n
                    kind = ("whole" if last else "head") if start == 0 else "tail" if last else "middle"
                    rows.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, (at + start) // length, (at + start) % length, kind))
                    start += size
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return written.mapInArrow(cut, PIECES)
