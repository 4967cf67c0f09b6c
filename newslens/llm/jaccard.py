"""Exact Jaccard self-join of word shingle sets by universe partition, pigeonhole and one-deletion neighbourhoods.

Two sets of at most `u` shingles whose Jaccard similarity reaches t differ in at most H = floor(2u (1 - t) / (1 + t)) shingles. Shingles are
hashed into H + 1 segments of the universe, so two such sets have at least one segment in common, and a signature per segment finds them.
Sizes are cut into bands by powers of `RATIO`; a set signs for its own band and, if it may have partners there, for the next one.

Cost-based allocation: a segment that holds few shingles of a set would be shared with many unrelated sets, so it gets no
signature (-1); which number counts as few follows from a band's shingles per segment, so that neighbourhoods add a tenth of signatures at
most, and an empty segment always does. The segment after it gets a one-deletion neighbourhood (+1): its whole content and its content without each shingle.
Two sets that agree in such a segment made the same allocation, so the budget H + 1 stays covered: with `a` such segments in common and no
match in their successors, each of these differs in two shingles or more, and the sum of differences exceeds H again. Nothing is lost.

Equal sets are one class from the start. Classes that share a signature are compared exactly, but never all with all. The centre of a
group is its class of most shared signatures. Each class is compared with the most shared of its centres, one that is not linked to it with all of
its centres; a group that this leaves connected is done, in the others every class is compared with the centre. Two classes of a group can only be linked past the centre if one of them, x,
is not linked to it. A difference from the centre that only one of two linked classes x and y has is a difference between them, so y misses at
most (1 - t) / t |y| of its own in x; if y is linked to the centre, x is not, and y shares more than (|y - c| - L(|y| - |c|)) / 2 of its own, with
L = (1 - t) / (1 + t). Of the shingles that y has more than the centre, it misses at most L |y| if x is as large as y or larger, and (1 - t) |y| if x is
smaller; if it has more of them, one is shared. Prefix filtering finds these pairs: with added shingles before missing ones, the first difference
that both have is among the first of each, one more than it may miss. Sets are kept with the shingles that fewest classes have first, so the first added
ones are shingles of a copy's own edits, which copies of other edits don't have: not those that many have since the centre lost them or an edit
was copied on, and not those that a copy lost, which many have lost. The differences before the first shared one and the numbers of
those after it bound how alike two classes can be, so pairs that can't reach t are not formed, nor are pairs that are connected already. Found pairs
are verified too.
Components are closed by large-star and small-star rounds until nothing changes.

Null and empty texts have no shingle and no link; a text with fewer words than a shingle has its whole sequence as one. Null ids count as
the smallest id and come out as null. Rows that share an id are one document, linked as any of its texts is. No other column is read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm import hashing
from newslens.llm.common import NO_ID, Scratch, blocks, document, documents, fresh
from newslens.operators.components import components

RATIO = 1.3
#: Characters of the texts that are hashed at a time; this takes several numbers for each word and character.
HASHED_CHARS = 1 << 20
#: Sets that are laid out by shingle at a time.
SETS = 512
#: Signatures of one-deletion neighbourhoods, as a part of all.
EXTRA = 0.1


class Bands:
    """Size bands and the numbers of segments, in whole-number arithmetic on the threshold."""

    def __init__(self, percent: int):
        self.threshold = Fraction(percent, 100)
        self.tops: list[int] = [1]

    def top(self, band: int) -> int:
        """Largest size of a band."""
        while len(self.tops) <= band:
            self.tops.append(max(self.tops[-1] + 1, math.floor(self.tops[-1] * RATIO)))
        return self.tops[band]

    def of(self, size: int) -> int:
        band = 0
        while self.top(band) < size:
            band += 1
        return band

    def segments(self, band: int) -> int:
        t = self.threshold
        return math.floor(2 * self.top(band) * (1 - t) / (1 + t)) + 1

    def few(self, band: int) -> int:
        """Shingles of a segment up to which the next segment's neighbourhood is the cheaper choice."""
        mean = 0.88 * self.top(band) / self.segments(band)
        k, term = 0, math.exp(-mean)
        total = term
        while True:
            term *= mean / (k + 1)
            if (total + term) * (mean + 1) > EXTRA:
                return k
            total += term
            k += 1

    def need(self, size: int, band: int) -> int:
        """Segments in which a set of this size agrees with any partner in a band at least."""
        t = self.threshold
        partner = min(math.floor(size / t), self.top(band))
        return self.segments(band) - math.floor((size + partner) * (1 - t) / (1 + t))

    def signed_for(self, size: int) -> list[tuple[int, int, int]]:
        """(band, segments, few) for which a set of this size signs: its own, and each further one that holds sizes of possible partners."""
        own = self.of(size)
        out, band = [(own, self.segments(own))], own + 1
        while Fraction(size) >= self.threshold * (self.top(band - 1) + 1):
            out.append((band, self.segments(band)))
            band += 1
        return [(b, m, self.few(b)) for b, m in out if m > 1]


def signatures(tokens: np.ndarray, band: int, segments: int, few: int) -> tuple[np.ndarray, int]:
    """Signatures of a set (distinct 64-bit hashes) for a band, and the number of segments that got none."""
    where = (hashing.mixed(tokens ^ np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    where = where.astype(np.int64)
    count = np.bincount(where, minlength=segments)
    value = hashing.mixed(tokens + np.uint64(0x632BE59BD9B4E019))
    total = np.zeros(segments, np.uint64)
    np.add.at(total, where, value)
    salt = hashing.mixed((np.arange(segments) + (band << 32)).astype(np.uint64))
    cheap = count <= few
    out = [hashing.mixed((total ^ salt) + count.astype(np.uint64))[~cheap]]
    wide = np.zeros(segments, dtype=bool)
    wide[(np.flatnonzero(cheap) + 1) % segments] = True
    if wide.any():
        mark = hashing.mixed(salt + np.uint64(1))
        out.append(hashing.mixed((total ^ mark) + count.astype(np.uint64))[wide])
        member = wide[where]
        left = where[member]
        out.append(hashing.mixed(((total[left] - value[member]) ^ mark[left]) + (count[left] - 1).astype(np.uint64)))
    return np.unique(np.concatenate(out)), int(cheap.sum())


def identity(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Slices of a batch and the distinct shingles of their texts in ascending order."""
    texts = batch.column("text").to_pylist()
    for a, b in blocks(texts, HASHED_CHARS):
        h, owner = hashing.distinct_shingles(*hashing.word_hashes(texts[a:b], lower=True), words)
        yield a, b, np.split(h, np.searchsorted(owner, np.arange(1, b - a)))


PROFILE = "doc long, part long, n_shingles long, same binary, bands array<struct<band:int,need:int,signs:array<long>>>"


def profiles(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per document: size and identity of its set, and its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for a, b, found in sets(batch, words):
                counts, numbers, needs, signs = [0], [], [], []
                for t in found:
                    for band in bands.signed_for(len(t)) if len(t) else []:
                        values, unsigned = signatures(t, *band)
                        numbers.append(band[0])
                        needs.append(max(1, bands.need(len(t), band[0]) - unsigned))
                        signs.append(values)
                    counts.append(len(signs))
                flat = hashing.signed(np.concatenate([*signs, np.empty(0, np.uint64)]))
                each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, signs)]), pa.int32()), pa.array(flat, pa.int64()))
                rows = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(needs, pa.int32()), each], names=["band", "need", "signs"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(a, b - a),
                        batch.column("part").slice(a, b - a),
                        pa.array([len(t) for t in found], pa.int64()),
                        pa.array([identity(t) if len(t) else None for t in found], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows),
                    ],
                    names=["doc", "part", "n_shingles", "same", "bands"],
                )

    return documents(docs).mapInArrow(run, PROFILE)


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, tokens) of the wanted classes; tokens are the hashes of the set as bytes. `wanted` has class and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in sets(batch, words):
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, b - a), pa.array([t.tobytes() for t in found], pa.binary())], names=["class", "tokens"])

    keys = wanted.select(F.col("class").alias("c"), F.col("part").alias("p"))
    return documents(docs).join(keys, (F.col("doc") == F.col("c")) & (F.col("part") == F.col("p")), "left_semi").mapInArrow(run, "class long, tokens binary")


def rare_first(tokens: DataFrame) -> DataFrame:
    """The same sets, in each the shingles that fewest sets hold first, those of equal counts by hash: one order for all. `tokens` is a written table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, SETS) for whole in batches for a in range(0, whole.num_rows, SETS)):
            found = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column("tokens")]
            sizes = list(map(len, found))
            owners = [pa.array(np.repeat(np.array(batch.column(c)), sizes)) for c in ("set", "class")]
            yield pa.RecordBatch.from_arrays([*owners, pa.array(np.concatenate([*found, np.empty(0, np.int64)]))], names=["set", "class", "token"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(s.values).tobytes() for s in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(rows, pa.binary())], names=["class", "tokens"])

    shingles = tokens.withColumn("set", F.monotonically_increasing_id()).mapInArrow(each, "set long, class long, token long")
    shared = shingles.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("n")).where("n > 1")
    ranked = shingles.join(shared, F.col("token") == F.col("t"), "left").select("set", "class", F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["token"])
    return ranked.groupBy("set", "class").agg(ordered.alias("tokens")).select("class", "tokens").mapInArrow(packed, "class long, tokens binary")


def shared_size(u: np.ndarray, v: np.ndarray) -> int:
    both = np.sort(np.concatenate([u, v]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets really reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    keep.append(False)
                else:
                    shared = shared_size(u, v)
                    keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_sets(pairs, tokens).mapInArrow(run, "a long, b long")


def with_sets(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    left = tokens.select(F.col("class").alias("a"), F.col("tokens").alias("x"))
    right = tokens.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


SPOKES = "a long, b long, n int, odd boolean, added int, missing int, as_small int, as_large int, head array<long>"


def compared(spokes: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """For pairs of a centre a and a class b: its size, whether they are not linked, how many shingles b has more and lacks, and the first of these
    differences in both roles of `past_centres`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, odd, more, less, small, large, heads = [], [], [], [], [], [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                added, missing = v[~np.isin(v, u, assume_unique=True)], u[~np.isin(u, v, assume_unique=True)]
                n, shared, apart = len(v), len(v) - len(added), len(added) + len(missing)
                sizes.append(n)
                more.append(len(added))
                less.append(len(missing))
                odd.append(100 * shared < percent * (len(u) + n - shared))
                # Differences that b may not share with a partner at most; one that is linked to the centre has partners that are not.
                miss = (100 - percent) * n // percent
                if not odd[-1]:
                    miss = min(miss, apart - (apart * (100 + percent) - (100 - percent) * (n - len(u))) // (2 * (100 + percent)) - 1)
                # The same for added shingles only, beside a partner of its size or larger, and beside a smaller one.
                for role, most in ((small, (100 - percent) * n // (100 + percent)), (large, (100 - percent) * n // 100)):
                    role.append(max(0, (min(miss, most) if len(added) > most else miss) + 1))
                heads.append(hashing.signed(np.concatenate([added, missing])[: max(small[-1], large[-1])]))
            flat = np.concatenate(heads) if heads else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a"), batch.column("b"), pa.array(sizes, pa.int32()), pa.array(odd, pa.bool_()),
                    pa.array(more, pa.int32()), pa.array(less, pa.int32()), pa.array(small, pa.int32()), pa.array(large, pa.int32()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(flat, pa.int64())),
                ],
                names=[x.split()[0] for x in SPOKES.split(", ")],
            )

    return with_sets(spokes, tokens).mapInArrow(run, SPOKES)


def past_centres(star: DataFrame, near: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of classes that may be linked although not both are linked to their centre; `near` has what is connected so far.

    The differences of both are in one order, added shingles first and then missing ones, each in the order of `rare_first`. The first one they share is among the first
    of each, one more than it may miss. All before it in either and the surplus of the one that has more after it are differences between the two.
    """
    roots = near.withColumnsRenamed({"node": "_node", "root": "_root"})
    star = star.join(roots, F.col("b") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "b")).drop("_node", "_root")
    opened = star.groupBy(F.col("a").alias("centre")).agg(F.max("odd").alias("odd"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    known = star.join(opened.where("odd and r0 <> r1").select("centre"), F.col("a") == F.col("centre")).drop("centre")
    known = scratch.keep("known", known)
    fields = ["b", "root", "n", "odd", "added", "missing"]

    def role(first: str) -> DataFrame:
        rows = known.select("a", *fields, F.posexplode(F.slice("head", 1, F.col(first))).alias("at", "token"))
        return rows.select(F.xxhash64("a", "token").alias("key"), *fields, "at")

    small, large = role("as_small"), role("as_large").withColumnsRenamed({c: f"_{c}" for c in ["key", *fields, "at"]})
    surplus = F.abs(F.col("added") + F.col("missing") - F.col("at") - F.col("_added") - F.col("_missing") + F.col("_at"))
    parted = F.abs(F.col("added") - F.col("at") - F.col("_added") + F.col("_at")) + F.abs(F.col("missing") - F.col("_missing"))
    apart = F.col("at") + F.col("_at") + F.when(F.col("at") < F.col("added"), parted).otherwise(surplus)
    alike = apart * (100 + percent) <= (F.col("n") + F.col("_n")) * (100 - percent)
    open_ = (F.col("root") != F.col("_root")) & (F.col("odd") | F.col("_odd"))
    pairs = small.join(large, (F.col("key") == F.col("_key")) & (F.col("b") != F.col("_b")) & (F.col("n") <= F.col("_n")) & open_ & alike)
    return pairs.select(F.least("b", "_b").alias("a"), F.greatest("b", "_b").alias("b")).distinct()


def spoked(members: DataFrame) -> DataFrame:
    """(sign, b, a, fame): the classes of each group but its centre a.

    The class that shares most signatures is the centre of its groups: it is likest to the text the others were made from.
    """
    fame = members.groupBy("class").agg(F.sum("n").alias("fame"))
    top = members.join(fame, "class").groupBy(F.col("sign").alias("g")).agg(F.max(F.struct("fame", -F.col("class"))).alias("top"))
    met = members.join(top, F.col("sign") == F.col("g")).select("sign", F.col("class").alias("b"), (-F.col("top.col2")).alias("a"), "top.fame")
    return met.where("a <> b")


def open_groups(groups: DataFrame, near: DataFrame) -> DataFrame:
    """The spokes (a, b) of groups that are not connected yet."""
    roots = [near.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root")) for c in "ab"]
    rooted = groups.join(roots[0], F.col("a") == F.col("a_node"), "left").join(roots[1], F.col("b") == F.col("b_node"), "left")
    rooted = rooted.select("sign", F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
    apart = rooted.groupBy(F.col("sign").alias("g")).agg(F.min(F.least("x", "y")).alias("lo"), F.max(F.greatest("x", "y")).alias("hi")).where("lo <> hi")
    return groups.join(apart.select("g"), F.col("sign") == F.col("g")).select("a", "b").distinct()


def counted(members: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(sign, class, part, n): members of signatures that several classes share, without classes that share too few in a band.

    A set shares more than one segment with any partner, unless it is as large as its band allows; segments without a signature are
    taken off what it needs. The others have no partner in the band. `members` has (sign, k), `keys` what each k is: a class in a band.
    """
    enough = members.groupBy("k").agg(F.count("*").alias("n")).join(keys, "k").where("n >= need").select(F.col("k").alias("key"), "class", "part")
    kept = scratch.keep("kept", members.join(enough, F.col("k") == F.col("key")).select("sign", "class", "part"))
    scratch.drop("members")
    sizes = kept.groupBy(F.col("sign").alias("g")).agg(F.count("*").alias("n")).where("n > 1")
    out = scratch.keep("counted", kept.join(sizes, F.col("sign") == F.col("g")).select("sign", "class", "part", "n"))
    scratch.drop("kept")
    return out


def linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc, part, n_shingles, component) of each row; `component` is the smallest doc of those reachable by links.

    Signatures are the bulk of the data. They are written once for each class, move with a number for their class and band only, and each
    written table goes when its last reader is written.
    """
    scratch = Scratch(docs.sparkSession)
    whole = scratch.keep("profiles", profiles(docs, words, percent))
    rows = scratch.keep("rows", whole.drop("bands"))
    full = rows.where("same is not null")
    classes = scratch.keep("classes", full.groupBy("same").agg(F.min(F.struct("doc", "part")).alias("first")).select("same", F.col("first.doc").alias("class"), F.col("first.part").alias("at")))
    twins = full.groupBy("doc").agg(F.min("same").alias("s0"), F.max("same").alias("s1")).where("s0 <> s1").select(F.col("doc").alias("twin"))
    twins = full.join(twins, F.col("doc") == F.col("twin")).select("twin", F.col("same").alias("s")).join(classes.select("same", "class"), F.col("s") == F.col("same"))
    leads = twins.groupBy(F.col("twin").alias("t")).agg(F.min("class").alias("b"))
    given = scratch.keep("given", twins.join(leads, F.col("twin") == F.col("t")).select(F.col("class").alias("a"), "b").where("a <> b").distinct())
    first = (F.col("doc") == F.col("class")) & (F.col("part") == F.col("at")) & (F.col("same") == F.col("s"))
    one = whole.where("same is not null").join(classes.select("class", "at", F.col("same").alias("s")), first)
    one = one.select("class", F.col("at").alias("part"), F.explode("bands").alias("b")).select("class", "part", "b.*")
    one = scratch.keep("signs", one.withColumn("k", F.monotonically_increasing_id()))
    scratch.drop("profiles")
    keys = scratch.keep("keys", one.select("k", "class", "part", "need"))
    shared = scratch.keep("shared", one.select(F.explode("signs").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    signed = one.select("k", F.explode("signs").alias("sign"))
    members = scratch.keep("members", signed.join(shared, F.col("sign") == F.col("g")).drop("g"))
    scratch.drop("signs", "shared")
    members = counted(members, keys, scratch)
    known = members.select("class", "part").distinct()
    tokens = scratch.keep("tokens", rare_first(scratch.keep("sets", shingle_sets(docs, known, words))))
    scratch.drop("sets")
    groups = scratch.keep("groups", spoked(members))
    scratch.drop("counted")
    first = groups.groupBy("b").agg(F.max(F.struct("fame", -F.col("a"))).alias("top")).select((-F.col("top.col2")).alias("a"), "b")
    star = scratch.keep("star", compared(first, tokens, percent))
    strays = star.where("odd").select(F.col("b").alias("stray")).distinct()
    done = star.select("a", "b").distinct()
    others = groups.join(strays, F.col("b") == F.col("stray")).select("a", "b").distinct().join(done, ["a", "b"], "left_anti")
    star = star.union(scratch.keep("others", compared(others, tokens, percent)))
    near = components(star.where("not odd").select("a", "b").union(given))
    rest = open_groups(groups, near).join(star.select("a", "b").distinct(), ["a", "b"], "left_anti")
    star = star.union(scratch.keep("rest", compared(rest, tokens, percent)))
    scratch.drop("groups")
    near = components(star.where("not odd").select("a", "b").union(given))
    more = scratch.keep("more", verified(past_centres(star, near, percent, scratch), tokens, percent))
    scratch.drop("tokens", "known")
    final = components(near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    class_root = classes.join(final, F.col("class") == F.col("node"), "left").select(F.col("same").alias("s"), F.coalesce("root", "class").alias("root"))
    return rows.join(class_root, F.col("same") == F.col("s"), "left").select("doc", "part", "n_shingles", F.coalesce("root", "doc").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row, for shingles of `words` words and a similarity of `percent` hundredths or more."""
    out = linked(docs, words, percent)
    return out.select(*[F.when(F.col(c) != NO_ID, F.col(c)).alias(n) for c, n in (("doc", "doc_id"),)], "n_shingles", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with the document of the smallest id of each group of linked ones; rows without shingles all stay."""
    later = linked(docs, words, percent).where("doc <> component").select("doc", "part").distinct()
    doc, part = fresh(docs, "doc_key", "part_key")

    key, check, _ = document()
    keyed = docs.withColumns({doc: key, part: check})
    gone = later.select(F.col("doc").alias(f"{doc}_r"), F.col("part").alias(f"{part}_r"))
    return keyed.join(gone, (F.col(doc) == F.col(f"{doc}_r")) & (F.col(part) == F.col(f"{part}_r")), "left_anti").drop(doc, part)


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s FROM d),
t AS (SELECT doc_id, unnest(s) AS x FROM f),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN f u ON u.doc_id = a JOIN f v ON v.doc_id = b WHERE 100 * n >= 90 * (len(u.s) + len(v.s) - n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM f UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT f.doc_id, len(s) AS n_shingles, c AS component_id FROM f JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) USING (doc_id)
"""
