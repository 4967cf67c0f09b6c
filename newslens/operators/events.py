"""Notes about the same event, found by the likeness of their titles.

All titles of an edition whose sets of words have a Jaccard similarity of LIKENESS or more are linked, and an event is a connected group. Titles
with equal words are one node, so copies cost nothing. Words are put in one order, rare ones first; two titles that are alike enough share a word
among the first few of both (prefix filter), where the words from there on must suffice (position and length filter). So titles meet by (edition,
word), and each pair is verified on the whole sets.

Only what is connected matters, so pairs within a connected group need not be formed: first every title of a bucket is compared with the bucket's
first one, and what that connects is one group. A bucket that is left with one group is done; in the others only titles of different groups meet.
A bucket of many titles is cut by the next word that two of them share, and again while buckets are large: titles that are alike although more
than `depth` words must be shared have their first `depth` + 1 shared words in a prefix that is longer by as many. Those that need `depth` words
only are alike already, as are both and the title with the smallest set of the bucket, so one link for each title stands for their pairs. In
what is large after `DEEPEST` words titles meet by the sizes of their sets as well, which leaves out pairs that the filters rule out.
Titles meet without their words: `SLOTS` whole numbers have a bit for each word, and bits that only one of two titles has bound how alike the two
can be. Words join the few pairs that are left, each once.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.text import lower_simple
from newslens.operators.components import components
from newslens.session import staged

#: Jaccard similarity of their words from which two titles are about the same event.
LIKENESS = 0.5
#: A word is frequent if it is this part of all words of titles; so at most as many words are.
FREQUENT = 10_000
#: Titles in a bucket from which it is cut by a further shared word.
LARGE_BUCKET = 64
#: Whole numbers of 64 bits that stand for the words of a title.
SLOTS = 4
#: Shared words of a bucket from which it is not cut any more.
DEEPEST = 4


def title_words(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_simple(title), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _least(x: Column) -> Column:
    """The next whole number, with room for rounding errors of a likeness that is no binary fraction."""
    return F.ceil(x - 1e-9).cast("int")


def _alike(x: Column, y: Column, likeness: float) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return shared >= likeness * (F.size(x) + F.size(y) - shared)


def _bits(words: Column) -> list[Column]:
    """Whole numbers with a bit for each word."""
    one = F.lit(1).cast("long")

    def slot(k: int) -> Column:
        own = F.filter(words, lambda x: F.shiftright(F.xxhash64(x), 6).bitwiseAND(SLOTS - 1) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", one, F.xxhash64(x).bitwiseAND(63).cast("int"))))

    return [slot(k).alias(f"bits{k}") for k in range(SLOTS)]


BITS = [f"bits{k}" for k in range(SLOTS)]


def _may_be_alike(likeness: float) -> Column:
    """Whether two titles can be alike by their bits: each that one of them has only is a word that one of them has only."""
    apart = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in BITS])
    both = F.col("n") + F.col("_n")
    return both - apart >= likeness * (both + apart) - 1e-9


def _verified(met: DataFrame, ranked: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) of those with the titles (id, _id) whose words are alike."""
    words = [ranked.select(F.col("id").alias(f"{c}_id"), F.col("w").alias(c)) for c in "xy"]
    joined = met.distinct().join(words[0], F.col("id") == F.col("x_id")).join(words[1], F.col("_id") == F.col("y_id"))
    return joined.where(_alike(F.col("x"), F.col("y"), likeness)).select("a", "b")


def _rare_first(nodes: DataFrame) -> DataFrame:
    """Words of each node in one order for all: those that are not frequent by name, then frequent ones by their count."""
    words = nodes.select("edition_date", "label", F.explode("w").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("k"))
    total = nodes.agg(F.sum(F.size("w"))).first()[0] or 0
    frequent = [(r.word, r.k) for r in counts.where(F.col("k") * FREQUENT > total).collect()]  # FREQUENT words at most
    known = F.broadcast(nodes.sparkSession.createDataFrame(frequent, "word string, k bigint"))
    ranked = words.join(known, "word", "left").select("edition_date", "label", F.struct(F.coalesce("k", F.lit(0)).alias("k"), "word").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["word"])
    return ranked.groupBy("edition_date", "label").agg(ordered.alias("w"))


def _fitting(rows: DataFrame, likeness: float, depth: int) -> DataFrame:
    """Rows with `most`, the largest set a title can be alike if its shared words number `depth` up to place `at`; others are left out."""
    # Up to there and after it so many words are shared at most, which must be t / (1 + t) of both sizes.
    fits = F.floor((F.col("n") - F.col("at") + (depth - 1)) * ((1 + likeness) / likeness) + 1e-9) - F.col("n")
    most = F.least(F.floor(F.col("n") / likeness + 1e-9), fits).cast("int")
    return rows.withColumn("most", most).where(F.col("most") >= _least(F.col("n") * likeness))


def _entries(ranked: DataFrame, likeness: float) -> DataFrame:
    """A row for each word in the prefix of a node: (edition_date, word, label, id, bits, n: size of the set, at: place, most: largest set it can be alike)."""
    n = F.size("w")
    first = F.slice("w", F.lit(1), n - _least(likeness * n) + 1)
    return _fitting(ranked.select("edition_date", "label", "id", *BITS, n.alias("n"), F.posexplode(first).alias("at", "word")), likeness, 1)


def _deeper(many: DataFrame, ranked: DataFrame, likeness: float, depth: int) -> DataFrame:
    """Entries of `depth` words from those of one less: a row for each later word in a prefix that is longer by one."""
    after = F.slice("w", F.col("at") + 2, F.greatest(F.lit(0), F.col("n") - _least(F.col("n") * likeness) + depth - F.col("at") - 1))
    worded = many.join(ranked.select(F.col("id").alias("w_id"), "w"), F.col("id") == F.col("w_id"))
    rows = worded.select("edition_date", "label", "id", *BITS, "n", "root", "word", "at", F.posexplode(after).alias("step", "next"))
    words, at = F.concat_ws(" ", "word", "next"), F.col("at") + F.col("step") + 1
    return _fitting(rows.withColumns({"word": words, "at": at}).drop("step", "next"), likeness, depth)


def _links(entries: DataFrame, ranked: DataFrame, likeness: float, large: int, deepest: int) -> DataFrame:
    """Pairs (a, b) of groups of which two titles were found alike."""
    keys = ["edition_date", "word"]
    names = {c: f"_{c}" for c in ("label", "id", *BITS, "n", "at", "most", "root")}

    def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        apart = (F.col("root") != F.col("_root")) & (F.col("_n") <= F.col("most")) & (F.col("n") <= F.col("_most"))
        order = (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("label") < F.col("_label")))
        met = left.join(right.withColumnsRenamed(names), on).where(apart & order & _may_be_alike(likeness))
        return met.select("id", "_id", F.col("root").alias("a"), F.col("_root").alias("b"))

    found, stars = [], []
    for depth in range(1, deepest + 1):
        smallest = [F.min("n").alias("n0"), F.min_by("root", F.struct("n", "label")).alias("r0")]
        groups = entries.groupBy(*keys).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k"), *smallest).where("lo < hi")
        held = staged(entries.join(groups.select(*keys, (F.col("k") > large).alias("big"), "n0", "r0"), keys))
        few, many = (held.where(c).drop("big", "n0", "r0") for c in (~F.col("big"), F.col("big")))
        found.append(pairs(few, few, keys))
        if many.isEmpty():
            break
        enough = F.lit(depth) >= likeness * (F.col("n") + F.col("n0") - depth)
        stars.append(held.where(F.col("big") & enough & (F.col("root") != F.col("r0"))).select(F.col("root").alias("a"), F.col("r0").alias("b")))
        if depth < deepest:
            entries = staged(_deeper(many, ranked, likeness, depth + 1))
            continue
        # The smaller set names the sizes it could be alike, the larger one the sizes down to which it could.
        up = many.where(F.col("most") >= F.col("n")).select("*", F.explode(F.sequence("n", "most")).alias("size_b")).withColumn("size_a", F.col("n"))
        least = F.greatest(F.lit(1), _least(F.col("n") * likeness))
        down = many.select("*", F.explode(F.sequence(least, F.least("n", "most"))).alias("size_a")).withColumn("size_b", F.col("n"))
        found.append(pairs(up, down, [*keys, "size_a", "size_b"]))
    return reduce(DataFrame.union, [_verified(reduce(DataFrame.union, found), ranked, likeness), *stars]).distinct()


def same_event_groups(titles: DataFrame, likeness: float = LIKENESS, large: int = LARGE_BUCKET, deepest: int = DEEPEST) -> DataFrame:
    """(edition_date, seq, event_seq): every note with the smallest seq of its event. A title without words is an event of its own.

    `seq` is unique over all editions. Rows without an edition are compared with no others.
    """
    worded = titles.select("edition_date", "seq", title_words(F.col("title")).alias("w"))
    key = F.when(F.size("w") > 0, F.sha2(F.array_join(F.array_sort("w"), " "), 256)).otherwise(F.concat(F.lit("seq "), F.col("seq").cast("string")))
    members = staged(worded.withColumn("node", key))
    nodes = staged(members.groupBy("edition_date", "node").agg(F.min("seq").alias("label"), F.any_value("w").alias("w")))
    worded = _rare_first(nodes.where((F.size("w") > 0) & F.col("edition_date").isNotNull()))
    ranked = staged(worded.select("*", F.monotonically_increasing_id().alias("id"), *_bits(F.col("w"))))
    entries = staged(_entries(ranked, likeness))
    bucket = ["edition_date", "word"]
    least = F.min_by(F.struct("id", "n", *BITS), "label").alias("least")
    first = entries.groupBy(*bucket).agg(F.min("label").alias("b"), least, F.count("*").alias("k")).where("k > 1")
    first = first.select(*bucket, "b", *[F.col(f"least.{c}").alias(f"_{c}") for c in ("id", "n", *BITS)])
    met = entries.join(first, bucket).where((F.col("label") != F.col("b")) & _may_be_alike(likeness))
    stars = staged(_verified(met.select("id", "_id", F.col("label").alias("a"), "b"), ranked, likeness))
    near = components(stars).withColumnRenamed("node", "label")
    rooted = entries.join(near, "label", "left").withColumn("root", F.coalesce("root", "label"))
    # Groups are closed, so only groups are left to connect.
    far = components(_links(rooted, ranked, likeness, large, deepest)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    closed = nodes.join(near, "label", "left").withColumn("root", F.coalesce("root", "label")).join(far, "root", "left")
    found = closed.select(F.col("edition_date").alias("_edition"), F.col("node").alias("_node"), F.coalesce("top", "root").alias("event_seq"))
    same = F.col("edition_date").eqNullSafe(F.col("_edition")) & (F.col("node") == F.col("_node"))
    return members.join(found, same).select("edition_date", "seq", "event_seq")
