"""Toxicity: a weighted finite-state grammar over clauses, with its word weights learned from labelled documents.

Five transducers are composed over the words of a clause. The lexical one rewrites words to insults (with the weight of the word or of its
stem), threats, targets, negations, words of reporting, and the rest. The negation transducer turns an insult or threat shortly after a
negation into a negated one; the reporting transducer does so after a word of reporting or inside quotation marks; the target transducer
raises what is aimed at somebody in the same clause; the scoring transducer adds the weights of the clauses by kind. The kinds are weighed
against each other by a logistic regression on the labelled documents.

Null and empty texts: no clause, so the score of a document without matches. Repeated rows get equal scores. Labels that repeat a document:
toxic if one of them says so; null labels are not used. Without labels of both classes, fixed prior weights are used. Other columns of the
input are never read, and `score` leaves them as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import fresh
from newslens.session import staged

# Words of the closed classes.
NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine keiner nie niemals pas jamais aucun nunca jamás ningún tampoco".split())
REPORTING = frozenset("said says wrote writes called calls quoted quotes reported claims claimed allegedly sagte schrieb nannte behauptete dit écrit appelé aurait dijo escribió llamó supuestamente".split())
TARGETS = frozenset("you your you're u he she they him her them his their du dich dir ihr euch sie er tu toi te vous il elle ils eux tú ti vosotros usted ustedes él ella ellos".split())
THREATS = frozenset("kill hurt destroy beat shoot stab strangle murder burn töten umbringen verletzen schlagen tuer frapper détruire matar golpear destruir".split())

STEMS = (4, 5, 6)
TOKEN = re.compile(r"[\w'’]+|[.!?;\n\"“”«»]")
QUOTES = frozenset("\"“”«»")
BREAKS = frozenset(".!?;\n")
REACH = 3
KINDS = ("direct", "aimed", "negated", "reported", "threat", "entries", "density")
#: Weights without training: what a clause of each kind counts, and the intercept.
PRIOR = ((1.2, 1.6, 0.2, 0.3, 1.5, 0.4, 0.2), -3.0)
CACHE = 400_000


def features_of(text: str) -> set[str]:
    """Words of a text and the stems of its longer words (a stem is marked by '^')."""
    words = set(TOKEN.findall(text.lower()))
    return words | {f"^{w[:n]}" for n in STEMS for w in words if len(w) > n}


class Lexicon(dict):
    """The lexical transducer: word -> (class, weight, entry); looks a word up once, then keeps it."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple | None:
        if len(self) > CACHE:
            self.clear()
        entry = self[word] = self.read(word)
        return entry

    def read(self, word: str) -> tuple | None:
        if word in BREAKS:
            return "B", 0.0, word
        if word in QUOTES:
            return "Q", 0.0, word
        found = [(self.weights[f], f) for f in (word, *(f"^{word[:n]}" for n in STEMS if len(word) > n)) if f in self.weights]
        if found:
            return "I", *max(found)
        for mark, words in (("N", NEGATIONS), ("R", REPORTING), ("Y", TARGETS), ("T", THREATS)):
            if word in words:
                return mark, 1.0, word
        return None


def transduce(symbols: list[tuple | None]) -> tuple[float, ...]:
    """Runs the composed transducers over the symbols of a text; returns the summed weight of each kind of clause match."""
    sums, entries, hits = dict.fromkeys(KINDS, 0.0), set(), 0
    since_negation, reported, quoted, aimed, insult, threat = REACH + 1, False, False, False, 0.0, 0.0

    def close() -> None:
        nonlocal insult, threat, aimed
        if insult:
            sums["aimed" if aimed else "direct"] += insult
        if threat and aimed:
            sums["threat"] += threat
        insult = threat = 0.0
        aimed = False

    for s in symbols:
        since_negation += 1
        if s is None:
            continue
        mark, weight, entry = s
        if mark == "B":
            close()
            since_negation, reported = REACH + 1, False
            quoted = quoted and entry != "\n"
        elif mark == "Q":
            quoted = not quoted
        elif mark == "N":
            since_negation = 0
        elif mark == "R":
            reported = True
        elif mark == "Y":
            aimed = True
        else:
            if mark == "I":
                hits += 1
                entries.add(entry)
            if since_negation <= REACH:
                sums["negated"] += weight
            elif reported or quoted:
                sums["reported"] += weight
            elif mark == "I":
                insult += weight
            else:
                threat += weight
    close()
    sums["entries"] = float(len(entries))
    sums["density"] = 100.0 * hits / max(1, len(symbols))
    return tuple(math.log1p(sums[k]) for k in KINDS)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of words and stems, and the weights of the kinds of clauses."""

    weights: dict[str, float]
    kinds: tuple[float, ...] = PRIOR[0]
    intercept: float = PRIOR[1]
    terms: tuple[str, ...] = field(default=KINDS)

    def features(self, text: Column) -> Column:
        """Array of the summed clause weights by kind, of a text column."""
        weights = self.weights

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lexicon = Lexicon(weights)
            marked = lexicon.__getitem__
            for texts in batches:
                yield pd.Series([list(transduce(list(map(marked, TOKEN.findall(t.lower()))))) for t in texts])

        return run(F.coalesce(text, F.lit("")))

    def probability(self, features: Column) -> Column:
        total = F.lit(float(self.intercept))
        for i, w in enumerate(self.kinds):
            total = total + features[i] * F.lit(float(w))
        return 1 / (1 + F.exp(-total))

    def score(self, text: Column) -> Column:
        return self.probability(self.features(text))


def labelled(labels: DataFrame) -> DataFrame:
    rows = labels.where("toxic is not null and doc_id is not null")
    return rows.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def learn_weights(texts: DataFrame, support: float, least: float, size: int) -> dict[str, float]:
    """Log-odds of words and stems between toxic and other documents.

    A feature needs `support` of the toxic documents (three at least) and a log-odds of `least`; the `size` features of the largest
    toxic share are kept, which bounds the model. Counts cover all labelled documents; each task adds up its own before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(out, names=["feature", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(features_of(text))
                seen[toxic][""] += 1
                if len(seen[0]) + len(seen[1]) > 2 * CACHE:
                    yield flush()
        yield flush()

    counts = staged(texts.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    total = counts.where("feature = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    nt, nc, a = total["toxic"], total["clean"], 0.5
    odds = F.log((F.col("toxic") + a) / (nt - F.col("toxic") + a)) - F.log((F.col("clean") + a) / (nc - F.col("clean") + a))
    rows = counts.where((F.col("feature") != "") & (F.col("toxic") >= max(3, math.ceil(support * nt)))).select("feature", "toxic", odds.alias("weight"))
    best = rows.where(F.col("weight") >= least).orderBy(F.desc(F.col("toxic") * F.col("weight")), "feature").limit(size)
    return {r["feature"]: r["weight"] for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, support: float = 0.01, least: float = 2.5, size: int = 4096) -> ToxicityModel:
    """Learns a model from the labelled ones among `docs`. The lexicon holds `size` entries at most."""
    known = labelled(labels)
    body = F.coalesce("text", F.lit(""))
    # Labels grow with the corpus: the same merge join at every size.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), body.alias("text")).join(known.hint("merge"), F.col("id") == F.col("label_id")).select("text", "toxic")
    model = ToxicityModel(learn_weights(texts, support, least, size))
    if not model.weights:
        return model
    matched = docs.select(F.col("doc_id").cast("long").alias("id"), model.features(F.col("text")).alias("x"))
    rows = staged(matched.join(known, F.col("id") == F.col("label_id")).select("x", F.col("toxic").cast("double").alias("y")))
    return regress(rows, model)


def regress(rows: DataFrame, model: ToxicityModel, ridge: float = 0.05, rounds: int = 25) -> ToxicityModel:
    """Logistic regression by Newton steps; each step adds up one small matrix per task, and only its sum reaches the driver."""
    d = len(KINDS) + 1
    w = np.array([*PRIOR[0], PRIOR[1]])
    prior = w.copy()
    schema = "g array<double>"
    for _ in range(rounds):
        now = w

        def step(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros(d), np.zeros((d, d))
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column("x").flatten()).reshape(-1, d - 1)
                    x = np.hstack([x, np.ones((len(x), 1))])
                    p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30)))
                    g += x.T @ (np.array(batch.column("y")) - p)
                    h += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([[*g, *h.ravel()]], pa.list_(pa.float64()))], names=["g"])

        part = rows.mapInArrow(step, schema).select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(d + d * d)
        for r in part:
            flat[r["i"]] = r["v"]
        g, h = flat[:d] - ridge * (w - prior), flat[d:].reshape(d, d) + ridge * np.eye(d)
        move = np.linalg.solve(h, g)
        w = w + move / max(1.0, np.abs(move).max() / 4)
        if np.abs(move).max() < 1e-4:
            break
    return ToxicityModel(model.weights, tuple(w[:-1]), float(w[-1]))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; learned from the labels outside the held-out fold only."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is below `threshold`."""
    model = fit(docs, labels)
    (name,) = fresh(docs, "score")
    return docs.withColumn(name, model.score(F.col("text"))).where(F.col(name) < threshold).drop(name)
