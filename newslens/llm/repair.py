"""Repair of the structure of conversations: the cheapest edits that make the roles alternate as they should.

Turns are kept, given another role or deleted, and empty turns inserted, until the roles read `(system? (user assistant)+)?`. A path through a
graph of (turns read, state of that grammar) is a list of edits. Its weight is one whole number: the high digits are the cost, and below them
each place of the audit has three bits for its letter, from the left, with zeros after the last one. So smaller numbers are cheaper edits and,
at equal cost, the audit that comes first in ASCII order, and an ordinary minimum over whole numbers decides everything. Two audits of the same
turns, states and cost never start one another (what one had more would be inserts, which cost), so the minimum at a node holds for whatever
follows, and weights of stretches of turns can be joined: `Piece` has the least weight from each state to each state.

Rows are dealt out in the order of (conversation, turn, role, text) into ranges. A conversation inside a range is finished there. One that
may go on in the next range, which includes any that holds a large part of the rows, is summed up by one piece per range; these are joined, and
its repaired turns are hashed as a sorted stream. Rows that agree in everything are one row with a count before anything is dealt out, and what
was said before is found by an aggregation over (conversation, role, text).

Null roles and texts: one space. Null turns come first; equal turns are ordered by role, then text. Null conversation ids are one conversation.
Very long texts are hashed and looked at by their last character only. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import BLOCK_CHARS
from newslens.session import staged

# White space, ends of sentences, legal neighbours, the grammar of role initials (state -> initial -> state) and its ends.
BLANKS, SENTENCE_ENDS = " \t\n\x0b\x0c\r", ".!?"
NEIGHBOURS = {"su", "ua", "au"}
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
GIVEN = {"u": "user", "a": "assistant"}

# Letters of the audit: Delete, Insert, Keep, Rerole, in ASCII order, in BITS bits each.
LETTERS, BITS = "DIKR", 3
DIGIT = {c: i + 1 for i, c in enumerate(LETTERS)}
#: Turns of one graph; longer conversations are joined from pieces.
PIECE = 32


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Piece:
    """Least weight, with `width` places, and number of letters for each (state before, state after) of a stretch of turns."""

    width: int
    best: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    def then(self, after: Piece) -> Piece:
        width, best = self.width + after.width, {}
        for (p, q), (left, n) in self.best.items():
            cost, letters = divmod(left, 1 << BITS * self.width)
            for (r, s), (right, m) in after.best.items():
                if q == r:
                    more, rest = divmod(right, 1 << BITS * after.width)
                    weight = (cost + more << BITS * width) + (letters << BITS * after.width) + (rest << BITS * (self.width - n))
                    if (p, s) not in best or weight < best[p, s][0]:
                        best[p, s] = weight, n + m
        return Piece(width, best)

    def read(self, p: int, q: int) -> tuple[int, str]:
        """Cost and letters of the best way from `p` to `q`."""
        weight, n = self.best[p, q]
        cost, letters = divmod(weight, 1 << BITS * self.width)
        return cost, "".join(LETTERS[(letters >> BITS * (self.width - 1 - i) & 7) - 1] for i in range(n))

    @staticmethod
    def written(table: dict[str, list]) -> Piece:
        """From (cost, letters) by state before and after."""
        width = max(len(x[1]) for x in table.values())
        best = {}
        for key, (cost, letters) in table.items():
            value = 0
            for c in letters:
                value = value << BITS | DIGIT[c]
            best[int(key[0]), int(key[1])] = (cost << BITS * width) + (value << BITS * (width - len(letters))), len(letters)
        return Piece(width, best)


def graph(turns: list[tuple[str, str]], costs: Costs, starts: tuple[int, ...]) -> Piece:
    """The piece of a few turns (initial, fault), from inserts before the first to inserts after the last."""
    gap = sum(len(set(s) & set(GIVEN)) > 0 for s in NEXT.values())  # more inserts in one place would come back to a state
    width = len(turns) + gap * (len(turns) + 1)
    unit = 1 << BITS * width
    best = {}

    def least(at: dict[int, tuple[int, int]], q: int, weight: int, n: int) -> None:
        if q not in at or weight < at[q][0]:
            at[q] = weight, n

    def step(node: tuple[int, int], cost: int, letter: str) -> tuple[int, int]:
        weight, n = node
        return weight + cost * unit + (DIGIT[letter] << BITS * (width - 1 - n)), n + 1

    def inserted(at: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        new = dict(at)
        while new:
            found: dict[int, tuple[int, int]] = {}
            for q, node in new.items():
                for c in GIVEN:
                    if c in NEXT[q]:
                        least(found, NEXT[q][c], *step(node, costs.insert, "I"))
            new = {q: x for q, x in found.items() if q not in at or x[0] < at[q][0]}
            at |= new
        return at

    for p in starts:
        at = inserted({p: (0, 0)})
        for initial, fault in turns:
            after: dict[int, tuple[int, int]] = {}
            more = costs.truncated if fault == "truncated" else 0
            for q, node in at.items():
                least(after, q, *step(node, costs.delete, "D"))
                if fault not in ("blank", "duplicate"):
                    if initial in NEXT[q]:
                        least(after, NEXT[q][initial], *step(node, more, "K"))
                    for c in GIVEN:
                        if c in NEXT[q]:
                            least(after, NEXT[q][c], *step(node, costs.rerole + more, "R"))
            at = inserted(after)
        best |= {(p, q): x for q, x in at.items()}
    return Piece(width, best)


def piece(turns: list[tuple[str, str]], costs: Costs, starts: tuple[int, ...] = tuple(NEXT)) -> Piece:
    """The piece of any number of turns, joined two by two."""
    level = [graph(turns[i : i + PIECE], costs, starts if i == 0 else tuple(NEXT)) for i in range(0, max(1, len(turns)), PIECE)]
    while len(level) > 1:
        level = [level[i].then(level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def finish(whole: Piece) -> tuple[int, int, str]:
    """State at the end, cost and audit of the best legal result."""
    end = min((q for q in ENDS if (0, q) in whole.best), key=lambda q: whole.best[0, q][0])
    return end, *whole.read(0, end)


def plan(letters: str, state: int, initials: list[str]) -> Iterator[tuple[str, str]]:
    """For each turn, and once after the last: initials of turns inserted before it, and K, D or the initial of its new role."""
    before, i = "", 0
    for letter in letters:
        given = next((c for c in GIVEN if c in NEXT[state]), "")
        if letter == "I":
            before, state = before + given, NEXT[state][given]
            continue
        if letter != "D":
            state = NEXT[state][given if letter == "R" else initials[i]]
        yield before, given if letter == "R" else letter
        before, i = "", i + 1
    yield before, "D"


def lines(before: str, own: str, role: str | None, text: str | None) -> list[tuple[str, str]]:
    kept = [] if own == "D" else [(GIVEN.get(own, role), text)]
    return [(GIVEN[c], "") for c in before] + kept


class Digest:
    """SHA-256 of lines, with a line feed between each two."""

    def __init__(self):
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, found: list[tuple[str, str]]) -> None:
        for role, text in found:
            self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False


# --- Spark -----------------------------------------------------------------------------------------------------------------


def turns_of(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, copies) of a table of turns, each row once unless `copies` says otherwise."""
    said = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *said, (F.lit(1) if copies is None else copies).cast("long").alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The same with rows lost, emptied, without ends of sentences, doubled or given to the user, as a checksum of conversation and turn says."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    narrow = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return turns_of(narrow, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))


def _faults(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, the fault of the first of them and that of the others; rows without copies only name a conversation."""
    rows = staged(turns.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", F.sha2("text", 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = rows.where("copies > 0").groupBy("conv", "role", "said").agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1")
    said = said.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("said").alias("_said"), F.col("first.turn").alias("_turn"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("said") == F.col("_said"))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    late = F.col("_said").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))
    fault = F.when(end == "", "blank").when(late, "duplicate").when(F.instr(F.lit(SENTENCE_ENDS), end) == 0, "truncated").otherwise("")
    return rows.join(said, same, "left").select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


SUMS = ("blank", "duplicate", "truncated", "illegal")


def _summary(rows: list[tuple]) -> dict:
    """Counts of a stretch of turns (turn, role, text, fault) that can be added to those of the next."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    out = {f: sum(r[3] == f for r in rows) for f in SUMS[:3]}
    out["illegal"] = sum(a + b not in NEIGHBOURS for a, b in zip(initials, initials[1:], strict=False))
    return out | {"n": len(rows), "first": turns[:1], "last": turns[-1:], "turns": len(set(turns)), "ends": [initials[0], initials[-1]] if rows else []}


def _added(a: dict, b: dict) -> dict:
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    out = {f: a[f] + b[f] for f in SUMS} | {"n": a["n"] + b["n"], "first": a["first"] or b["first"], "last": b["last"] or a["last"], "ends": [a["ends"][0], b["ends"][1]]}
    out["illegal"] += a["ends"][1] + b["ends"][0] not in NEIGHBOURS
    out["turns"] = a["turns"] + b["turns"] - bool(a["last"] and a["last"] == b["first"])
    return out


def _figures(s: dict, cost: int, audit: str) -> list:
    return [s["last"][0] - s["first"][0] + 1 - s["turns"] if s["turns"] else 0, *[s[f] for f in SUMS], cost, audit]


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: What a range gives: 0 a finished conversation, 1 a piece of one that may go on, 2 a repaired turn, 3 a turn of such a piece.
FINISHED, PART, REPAIRED, TURN = range(4)


def _folded(rows: DataFrame, costs: Costs) -> DataFrame:
    conv = next(f.dataType for f in rows.schema.fields if f.name == "conv")
    schema = f"kind int, conv {conv.simpleString()}, part int, pos long, role string, text string, piece string, {FIGURES}, repaired_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]
    nothing = [None] * (len(FIGURES.split(", ")) + 1)

    def conversation(key, turns: list[tuple], part: int, whole: bool) -> Iterator[list]:
        initials = [t[1][:1] for t in turns]
        graph_rows = [(i, t[3]) for i, t in zip(initials, turns, strict=True)]
        summed = _summary(turns)
        if not whole:
            found = piece(graph_rows, costs)
            table = {f"{p}{q}": found.read(p, q) for p, q in found.best}
            yield [PART, key, part, None, None, None, json.dumps({"sums": summed, "initials": initials, "table": table}), *nothing]
            for i, t in enumerate(turns):
                yield [TURN, key, part, i, t[1], t[2], None, *nothing]
            return
        _, cost, audit = finish(piece(graph_rows, costs, (0,)))
        digest, pos = Digest(), 0
        for (before, own), t in zip(plan(audit, 0, initials), [*turns, (None, None, None, None)], strict=True):
            for role, text in (made := lines(before, own, t[1], t[2])):
                yield [REPAIRED, key, part, pos, role, text, None, *nothing]
                pos += 1
            digest.add(made)
        yield [FINISHED, key, *[None] * 5, *_figures(summed, cost, audit), digest.sha.hexdigest()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def read() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "fault")), strict=True)

        def results() -> Iterator[list]:
            held, first = None, True
            for key, group in groupby(read(), key=lambda r: r[0]):
                if held:
                    yield from conversation(*held, part, not first)
                    first = False
                turns = []
                for _, turn, role, text, copies, fault in group:
                    turns += [(turn, role, text, fault)] * min(copies, 1) + [(turn, role, text, fault if fault == "blank" else "duplicate")] * (copies - 1)
                held = key, turns
            if held:
                yield from conversation(*held, part, False)

        types = pa_types(conv)

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        out, chars = [], 0
        for row in results():
            out.append(row)
            chars += len(row[5] or "") + len(row[6] or "") + 64
            if chars > BLOCK_CHARS:
                yield batch_of(out)
                out, chars = [], 0
        if out:
            yield batch_of(out)

    dealt = rows.repartitionByRange("conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.mapInArrow(fold, schema)


def pa_types(conv) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.int32(), to_arrow_type(conv), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]


def _joined(parts: DataFrame, costs: Costs) -> DataFrame:
    """Figures (part is null) and the plan of each turn of conversations that came in several pieces."""
    conv = parts.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, part int, pos long, before string, own string, {FIGURES}"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa_types(parts.schema["conv"].dataType)[1], pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]

    def join(rows: pa.Table) -> pa.Table:
        order = sorted(zip(rows["part"].to_pylist(), rows["piece"].to_pylist(), strict=True))
        known = [json.loads(x) for _, x in order]
        pieces = [Piece.written(k["table"]) for k in known]
        sums, way, came = known[0]["sums"], Piece(0, {(0, 0): (0, 0)}), []
        for k in known[1:]:
            sums = _added(sums, k["sums"])
        for p in pieces:  # least weights from the start on, and from which state each comes
            after = way.then(p)
            via = {q: way.then(Piece(p.width, {x: w for x, w in p.best.items() if x[0] == q})).best for q in NEXT}
            came.append({s: next(q for q in NEXT if via[q].get((0, s)) == w) for (_, s), w in after.best.items()})
            way = after
        state, cost, audit = finish(way)
        out = [[None] * 4 + _figures(sums, cost, audit)]
        for (part, _), k, p, before in reversed(list(zip(order, known, pieces, came, strict=True))):
            letters = p.read(before[state], state)[1]
            out += [[part, i, *step, *[None] * 7] for i, step in enumerate(plan(letters, before[state], k["initials"]))]
            state = before[state]
        key = rows["conv"][0].as_py()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip([[key] * len(out), *zip(*out, strict=True)], types, strict=True)], names=names)

    return parts.groupBy("conv").applyInArrow(join, schema)


def repair(turns: DataFrame, costs: Costs | None = None) -> tuple[DataFrame, DataFrame]:
    """From turns (conv, turn, role, text, copies): a row of figures, audit and digest per conversation, and the repaired turns (conv_id, part, pos, role, text)."""
    costs = costs or Costs()
    found = staged(_folded(_faults(turns), costs))
    figures = [c.split()[0] for c in FIGURES.split(", ")]
    names = [F.col("conv").alias("conv_id"), *figures, "repaired_sha256"]
    joined = staged(_joined(found.where(F.col("kind") == PART).select("conv", "part", "piece"), costs))
    open_turns = found.where(F.col("kind") == TURN).select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), F.col("pos").alias("_pos"), "role", "text")
    steps = joined.where("part is not null")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("pos") == F.col("_pos"))
    planned = steps.join(open_turns, same, "left").select("conv", "part", "pos", "before", "own", "role", "text")
    conv = found.schema["conv"].dataType.simpleString()
    digests = planned.repartition("conv").sortWithinPartitions("conv", "part", "pos").mapInArrow(_hashed, f"_conv {conv}, repaired_sha256 string")
    late = joined.where("part is null").join(digests, F.col("conv").eqNullSafe(F.col("_conv"))).select(*names)
    summary = found.where(F.col("kind") == FINISHED).select(*names).unionByName(late)
    own = F.when(F.col("own") == "K", F.col("role")).otherwise(_given(F.col("own")))
    kept = F.when(F.col("own") != "D", F.struct(own.alias("role"), F.col("text").alias("text")))
    added = F.transform(F.filter(F.split("before", ""), lambda c: c != ""), lambda c: F.struct(_given(c).alias("role"), F.lit("").alias("text")))
    made = planned.select("conv", "part", F.col("pos").alias("turn"), F.posexplode(F.array_compact(F.concat(added, F.array(kept)))))
    late_lines = made.select("conv", "part", (F.col("turn") * (len(NEXT) + 1) + F.col("pos")).alias("pos"), "col.role", "col.text")
    repaired = found.where(F.col("kind") == REPAIRED).select("conv", "part", "pos", "role", "text").unionByName(late_lines)
    return summary, repaired.withColumnRenamed("conv", "conv_id")


def _given(initial: Column) -> Column:
    return F.when(initial == "u", GIVEN["u"]).when(initial == "a", GIVEN["a"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, types = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], types), pa.array([digest.sha.hexdigest()])], names=["_conv", "repaired_sha256"])

    for batch in batches:
        types = batch.column("conv").type
        for conv, before, own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "before", "own", "role", "text")), strict=True):
            if digest is None or conv != key:
                if digest:
                    yield done()
                key, digest = conv, Digest()
            digest.add(lines(before, own, role, text))
    if digest:
        yield done()


def repair_report(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))[0]
