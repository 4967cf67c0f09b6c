"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

The benchmark is the query set; it is worked off in blocks of about `ITEMS` passages, each against all documents. Documents and items are
read as passages of `2 * STEP` words, one every `STEP` words, so that an item of any length is searched in parts of theirs. TF-IDF weights
use document frequencies over all documents; the most frequent words still weigh log(2), and words that the block of items does not have
count in the length of a passage only. A passage whose known words make less than `cosine` of its length can't reach that cosine with any
item (Cauchy-Schwarz), so it is dropped without loss. All others are compared with all passages of items of the block by the cosine of their
whole TF-IDF vectors, over lists of the items that hold each word; so no such pair is lost, however many items there are. Pairs that are
near only in a latent space are taken as well. A randomised SVD finds it: tasks multiply their rows with a random matrix, add up the
products per block of terms, and the small factor is orthonormalised; two such passes and one for the Gram matrix suffice. The fit takes
all passages that can reach the cosine, and the items with the same total weight, so that both sides of the search shape the space;
latent vectors are compared by their directions. Frequent words beside rare ones make a small part of a passage's length, so `RUN` words in
a row that an item has too make a pair as well, whatever they weigh; items of fewer words have the cosine only. Each pair is checked in the
words of the whole item, in surroundings of its own length: an item is leaked if its longest common subsequence with the passage and its
surroundings holds `share` of the item, or `loose` of the item and `answer` of its last third, the part that answers; so reworded copies are
found and texts on the same matter are left alone.

Null and empty texts and items have no passage and no leak. Repeated rows and rows of one id are one document if their texts agree, and give
one row per item. Null ids of documents come out as null; items are known by their id and text. Empty tables give an empty result. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.common import NO_ID, Scratch, blocks, document, documents, fresh

WORD = re.compile(r"\w+")
#: Blanks in place of Latin-1 characters that are in no word.
BLANKS = bytes(c if WORD.fullmatch(chr(c)) else 32 for c in range(256))
STEP = 16
#: Passages of items per block of the benchmark, latent dimensions, extra dimensions of the search, features: these bound the model in the driver.
ITEMS = 10_000
RANK = 256
EXTRA = 16
FEATURES = 1 << 14
TERMS_PER_BLOCK = 512
#: Words in a row that an item and a passage share make them a pair whatever the words weigh.
RUN = 3
#: Characters of the texts that are cut into passages at a time.
CUT_CHARS = 1 << 20
#: Passages whose products are formed at a time.
FIT_ROWS = 512
#: Size of the table that most runs of words are told apart from those of the items by, before they are looked up.
MARK_BITS = 20
#: Pairs of passages and item vectors that a task compares at a time.
CELLS = 1 << 18
COSINE = 0.35
SHARE, LOOSE, ANSWER = 0.75, 0.6, 0.8


def words_of(text: str | None) -> list[str]:
    lower = (text or "").lower()
    try:
        return lower.encode("latin-1").translate(BLANKS).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(lower)


def common_subsequence(x: list, y: list) -> int:
    """Length of the longest common subsequence; one machine-word operation per word of `y` and 64 words of `x`."""
    return common_letters(letters(x), len(x), y)


def letters(x: list) -> dict:
    """For each word of `x` the bits of its places."""
    where: dict = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | 1 << i
    return where


def common_letters(where: dict, n: int, y: list) -> int:
    """Length of the longest common subsequence of `y` and the `n` words whose places `where` holds."""
    full = (1 << n) - 1
    row = full
    for w in y:
        if m := where.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return n - row.bit_count()


def code(features: np.ndarray, base: int) -> np.ndarray:
    """A number for every `RUN` features in a row."""
    out = np.zeros(max(0, len(features) - RUN + 1), np.int64)
    for k in range(RUN):
        out = out * base + features[k : len(features) - RUN + 1 + k]
    return out


def mark(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def pieces(words: list[str]) -> list[list[str]]:
    """An item in passages as those of the documents."""
    return [words[k : k + 2 * STEP] for k in range(0, max(1, len(words) - STEP), STEP)]


class Items:
    """A block of items with its vocabulary; `known` maps words to features.

    `vectors` has the passages that are searched, `of` their items, and `reach` how many words around a passage are read for an item.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.words = [words_of(r[1]) for r in rows]
        vocabulary = sorted({w for ws in self.words for w in ws})
        self.known = {w: i % FEATURES for i, w in enumerate(vocabulary)}
        self.size = min(FEATURES, len(vocabulary))
        cut = [pieces(ws) for ws in self.words]
        self.vectors = [v for c in cut for v in c]
        self.of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        runs = {(tuple(self.known[w] for w in ws[k : k + RUN]), i) for i, ws in enumerate(self.words) for k in range(len(ws) - RUN + 1)}
        codes = np.array([code(np.array(r), self.size + 1)[0] for r, _ in sorted(runs)], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.run_of = codes[order], np.array([i for _, i in sorted(runs)], np.int64)[order]
        self.marks = np.zeros(1 << MARK_BITS, bool)
        self.marks[mark(self.codes)] = True
        self.reach = [max(2 * STEP, len(ws)) for ws in self.words]


def frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents; one vector per task is added up."""
    known, size = items.known, items.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(size, np.int64), 0
        names = known.keys()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                total += 1
                found = {known[w] for w in names & words}
                seen[list(found)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], total), pa.int64())], names=["feature", "n"])

    rows = documents(docs).select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(size), 0
    for r in rows:
        if r["feature"] < 0:
            total = r["n"]
        else:
            counts[r["feature"]] = r["n"]
    return counts, total


def vector(words: list[str | None], known: dict[str, int], weight: np.ndarray, rare: float) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights over the passage's length; a word that occurs n times counts sqrt(n) times."""
    tally = Counter(known.get(w, -1) for w in words)
    other = tally.pop(-1, 0)
    at = np.fromiter(tally.keys(), np.int64, len(tally))
    values = weight[at] * np.sqrt(np.fromiter(tally.values(), np.float64, len(tally)))
    return at, values / (np.sqrt(float(values @ values) + other * rare * rare) or 1.0)


class Passages:
    """The passages of a block of documents: `start` and `end` in the words of all documents, `doc` their document.

    `at` is the feature of each word; of words that are not known, `other`.
    """

    def __init__(self, texts: list[str], known: dict[str, int], other: int):
        self.words = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.at = np.fromiter(map(known.get, chain.from_iterable(self.words), repeat(other)), np.int64, int(lengths.sum()))
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        cuts = -(-lengths // STEP)
        before = np.cumsum(cuts) - cuts
        doc = np.repeat(np.arange(len(texts)), cuts)
        self.cut = self.begins[doc] + STEP * (np.arange(len(doc)) - before[doc])
        place = np.arange(len(doc)) - before[doc]
        # The last cut of a document starts no passage of its own unless it is the only one.
        self.chosen = np.flatnonzero((place < cuts[doc] - 1) | (cuts[doc] == 1))
        self.alone = cuts[doc][self.chosen] == 1
        self.doc, self.start = doc[self.chosen], self.cut[self.chosen]
        self.end = np.minimum(self.start + 2 * STEP, self.ends[self.doc])

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """Sum over the words of each passage."""
        if not len(self.cut):
            return np.zeros(0)
        parts = np.append(np.add.reduceat(of_word, self.cut), 0.0)
        return parts[self.chosen] + np.where(self.alone, 0.0, parts[self.chosen + 1])

    def vectors(self, chosen: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (place in `chosen`), feature and weight of the known words of the chosen passages, in the order of rows and features."""
        size = len(weight)
        at = self.start[chosen][:, None] + np.arange(2 * STEP)
        inside = at < self.end[chosen][:, None]
        feature = np.where(inside, self.at[np.minimum(at, len(self.at) - 1)], size)
        keys, n = np.unique((feature + (size + 1) * np.arange(len(chosen))[:, None]).ravel(), return_counts=True)
        row, feature = np.divmod(keys, size + 1)
        keep = feature < size
        row, feature = row[keep], feature[keep]
        return row, feature, (weight[feature] * np.sqrt(n[keep] / total[chosen][row])).astype(np.float32)


def shared_runs(found: Passages, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Passage and item of all runs of words that they share."""
    codes = code(found.at, items.size + 1)
    place = np.flatnonzero(items.marks[mark(codes)])
    first, last = (np.searchsorted(items.codes, codes[place], side) for side in ("left", "right"))
    many = last - first
    item = items.run_of[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    place = np.repeat(place, many)
    doc = np.searchsorted(found.ends, place, "right")
    # Runs that go on into the next document are none; those of a document's last words lie in its last passage.
    inside = place + RUN <= found.ends[doc]
    place, doc, item = place[inside], doc[inside], item[inside]
    passage = np.searchsorted(found.start, place, "right") - 1
    pairs = np.unique(passage * len(items.ids) + item)
    return np.divmod(pairs, len(items.ids))


def reachable(found: Passages, weight: np.ndarray, rare: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The passages that can reach the cosine with some item, and the squared length of every passage."""
    mass = np.append(weight * weight, rare * rare)[found.at]
    inside, total = found.sums(np.where(found.at < len(weight), mass, 0.0)), found.sums(mass)
    return np.flatnonzero((inside > 0) & (inside >= cosine * cosine * total)), total


def fit_rows(docs: DataFrame, items: Items, weight: np.ndarray, rare: float, cosine: float) -> DataFrame:
    """All passages that can reach the cosine with some item: their features and weights."""
    known, size = items.known, items.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts, CUT_CHARS):
                found = Passages(texts[a:b], known, size)
                chosen, total = reachable(found, weight, rare, cosine)
                row, at, values = found.vectors(chosen, weight, total)
                ends = np.searchsorted(row, np.arange(len(chosen) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, t)) for v, t in ((at, pa.int32()), (values, pa.float32()))]
                yield pa.RecordBatch.from_arrays(lists, names=["features", "weights"])

    return documents(docs).select("text").mapInArrow(run, "features array<int>, weights array<float>")


def product(rows: DataFrame, right: np.ndarray) -> np.ndarray:
    """A'(A R) for the matrix A of the passages: tasks add up blocks of terms, blocks meet, and the small sum comes back."""
    d, width = right.shape
    small = right.astype(np.float32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, width))
        for batch in batches:
            ends = np.array(batch.column("features").offsets)
            features = np.array(batch.column("features").flatten())
            weights = np.array(batch.column("weights").flatten())
            for a in range(0, batch.num_rows, FIT_ROWS):
                at = ends[a : a + FIT_ROWS + 1] - ends[0]
                many = np.diff(at)
                many = many[many > 0]
                if not len(many):
                    continue
                feature, w = features[at[0] : at[-1]], weights[at[0] : at[-1], None]
                rows_of = np.add.reduceat(w * small[feature], np.cumsum(many) - many)
                order = np.argsort(feature, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(feature[order]) > 0))
                back = (w * np.repeat(rows_of, many, axis=0))[order]
                total[feature[order][first]] += np.add.reduceat(back, first)
        if total.any():
            cuts = range(0, d, TERMS_PER_BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(range(len(cuts))), pa.int32()), pa.array([total[c : c + TERMS_PER_BLOCK].tobytes() for c in cuts], pa.binary())], names=["block", "sums"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                part = np.frombuffer(part)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "sums"])

    # One sum for each core, however many files the passages lie in.
    few = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(multiply, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary").collect()
    out = np.zeros((d, width))
    for r in parts:
        at = r["block"] * TERMS_PER_BLOCK
        out[at : at + TERMS_PER_BLOCK] = np.frombuffer(r["sums"]).reshape(-1, width)
    return out


def latent_space(rows: DataFrame, item_rows: list[tuple[np.ndarray, np.ndarray]], size: int, rank: int) -> np.ndarray:
    """Right singular vectors (features x rank) of the passages and items together, by a randomised SVD with a fixed seed."""
    width = min(size, rank + EXTRA)
    scratch = Scratch(rows.sparkSession)
    rows = scratch.keep("fit", rows.select("features", "weights"))
    scale = max(1, rows.count()) / len(item_rows)

    def both(right: np.ndarray) -> np.ndarray:
        total = product(rows, right)
        for at, w in item_rows:
            total[at] += scale * w[:, None] * (w @ right[at])
        return total

    q = np.random.default_rng(7).standard_normal((size, width))
    for _ in range(2):
        q, _ = np.linalg.qr(both(q))
    gram = q.T @ both(q)
    scratch.drop("fit")
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    return (q @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


class Search:
    """Which vectors of the items are near a passage: by the cosine of the whole TF-IDF vectors, or by that of the latent ones."""

    def __init__(self, item_rows: list[tuple[np.ndarray, np.ndarray]], size: int, space: np.ndarray):
        at = np.concatenate([a for a, _ in item_rows])
        order = np.argsort(at, kind="stable")
        self.n, self.space = len(item_rows), space
        self.first = np.searchsorted(at[order], np.arange(size + 1))
        self.vector = np.repeat(np.arange(self.n), [len(a) for a, _ in item_rows])[order].astype(np.int32)
        self.value = np.concatenate([w for _, w in item_rows])[order].astype(np.float32)
        self.latent = unit(np.stack([w.astype(np.float32) @ space[a] for a, w in item_rows])).T.copy()

    def cosine_of(self, item: int, feature: np.ndarray, value: np.ndarray, of: np.ndarray) -> float:
        """Largest cosine of one passage with a vector of the item."""
        many = self.first[feature + 1] - self.first[feature]
        at = np.repeat(self.first[feature] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        whole = np.bincount(self.vector[at], np.repeat(value, many) * self.value[at], self.n)
        return float(whole[of == item].max(initial=0.0))

    def near(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, vector and cosine of the near pairs among `rows` passages; `row`, `feature` and `value` as Passages.vectors gives them."""
        step = max(1, CELLS // self.n)
        for a in range(0, rows, step):
            b = min(rows, a + step)
            lo, hi = np.searchsorted(row, (a, b))
            r, f, v = row[lo:hi] - a, feature[lo:hi], value[lo:hi]
            many = self.first[f + 1] - self.first[f]
            at = np.repeat(self.first[f] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            cell = np.repeat(r * self.n, many) + self.vector[at]
            whole = np.bincount(cell, np.repeat(v, many) * self.value[at], (b - a) * self.n).reshape(b - a, self.n)
            some, start = np.unique(r, return_index=True)
            latent = np.zeros((b - a, self.space.shape[1]), np.float32)
            if len(some):
                latent[some] = np.add.reduceat(v[:, None] * self.space[f], start, axis=0)
            i, j = np.nonzero((whole >= cosine) | (unit(latent) @ self.latent >= cosine))
            yield i + a, j, whole[i, j]


LEAKS = "doc long, part long, item_id long, start long, cosine double, share double, answer_share double"


def matches(
    docs: DataFrame, items: Items, weight: np.ndarray, rare: float, search: Search, cosine: float, share: float, loose: float, answer: float
) -> DataFrame:
    """Leaked items per passage."""
    names = [x.split()[0] for x in LEAKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [(letters(w), len(w)) for w in items.words]
        tails = [(letters(t), len(t)) for t in (w[-max(1, len(w) // 3) :] for w in items.words)]
        for batch in batches:
            keys, parts, texts = (batch.column(c).to_pylist() for c in ("doc", "part", "text"))
            out = []
            for a, b in blocks(texts, CUT_CHARS):
                found = Passages(texts[a:b], items.known, items.size)
                chosen, total = reachable(found, weight, rare, cosine)
                pairs: dict[tuple[int, int], float] = {}
                for i, j, near in search.near(len(chosen), *found.vectors(chosen, weight, total), cosine):
                    for p, item, x in zip(chosen[i].tolist(), items.of[j].tolist(), near.tolist(), strict=True):
                        pairs[p, item] = max(x, pairs.get((p, item), 0.0))
                for p, item in zip(*(x.tolist() for x in shared_runs(found, items)), strict=True):
                    pairs.setdefault((p, item), -1.0)
                for (p, item), x in pairs.items():
                    d = int(found.doc[p])
                    start = int(found.start[p] - found.begins[d])
                    around = found.words[d][max(0, start - items.reach[item]) : start + 2 * STEP + items.reach[item]]
                    common = common_letters(*whole[item], around) / whole[item][1]
                    if common < loose:
                        continue
                    answered = common_letters(*tails[item], around) / tails[item][1]
                    if common >= share or answered >= answer:
                        x = x if x >= 0 else search.cosine_of(item, *found.vectors(np.array([p]), weight, total)[1:], items.of)
                        out.append((keys[a + d], parts[a + d], items.ids[item], start, x, common, answered))
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return documents(docs).mapInArrow(run, LEAKS)


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of about ITEMS passages of items, whole items each, in the order of their ids and texts."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    block: list[tuple[int, str]] = []
    held = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if WORD.search(r["text"]):
            block.append((r["item_id"], r["text"]))
            held += len(pieces(words_of(r["text"])))
        if held >= ITEMS:
            yield Items(block)
            block, held = [], 0
    if block:
        yield Items(block)


def weigh(counts: np.ndarray, total: int, items: Items) -> tuple[np.ndarray, float, list[tuple[np.ndarray, np.ndarray]]]:
    """Weight of each feature, of any other word, and the vectors of the items as rows of the TF-IDF matrix."""
    weight = np.log1p((total + 1) / (counts + 0.5))
    rare = float(np.log1p((total + 1) / 1.5))
    return weight, rare, [vector(words, items.known, weight, rare) for words in items.vectors]


def leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, share: float = SHARE, loose: float = LOOSE, answer: float = ANSWER
) -> DataFrame:
    """One row per document and leaked item: where the best passage starts (in words), its cosine, and the shares of the common subsequences."""
    spark: SparkSession = docs.sparkSession
    found = spark.createDataFrame([], LEAKS)
    for items in item_blocks(benchmark):
        counts, total = frequencies(docs, items)
        weight, rare, item_rows = weigh(counts, total, items)
        space = latent_space(fit_rows(docs, items, weight, rare, cosine), item_rows, items.size, rank)
        search = Search(item_rows, items.size, space)
        found = found.unionByName(matches(docs, items, weight, rare, search, cosine, share, loose, answer))
    best = F.max(F.struct("share", "answer_share", "cosine", -F.col("start"))).alias("best")
    out = found.groupBy("doc", "part", "item_id").agg(best)
    return out.select("doc", "part", "item_id", (-F.col("best.col4")).alias("start"), F.col("best.cosine").alias("cosine"), F.col("best.share").alias("share"), F.col("best.answer_share").alias("answer_share"))


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = leaks(docs, benchmark)
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "item_id", "start", *[F.round(c, 6).alias(c) for c in ("cosine", "share", "answer_share")])


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold an item of the benchmark."""

    doc, part = fresh(docs, "doc_key", "part_key")
    key, check, _ = document()
    gone = leaks(docs, benchmark).select(F.col("doc").alias(f"{doc}_r"), F.col("part").alias(f"{part}_r")).distinct()
    keyed = docs.withColumns({doc: key, part: check})
    return keyed.join(gone, (F.col(doc) == F.col(f"{doc}_r")) & (F.col(part) == F.col(f"{part}_r")), "left_anti").drop(doc, part)
