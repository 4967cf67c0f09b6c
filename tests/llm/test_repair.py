"""Conversation repair against every list of edits, a search over pairs (cost, audit), and a plain repair of whole tables."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from newslens.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
FAULTS = ["", "", "", "truncated", "blank", "duplicate"]


def every_edit(turns):
    """Cheapest (cost, audit) among all lists of edits with two inserts at most."""
    found = []

    def go(i, roles, audit, cost, inserts):
        if i == len(turns) and LEGAL.match(roles):
            found.append((cost, audit))
        if inserts < 2:
            for c in "ua":
                go(i, roles + c, audit + "I", cost + 5, inserts + 1)
        if i < len(turns):
            initial, fault = turns[i]
            go(i + 1, roles, audit + "D", cost + 2, inserts)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                go(i + 1, roles + (initial or "?"), audit + "K", cost + more, inserts)
                for c in "ua":
                    go(i + 1, roles + c, audit + "R", cost + more + 1, inserts)

    go(0, "", "", 0, 0)
    return min(found)


def search(turns, costs):
    """The same by a search that keeps audits as text."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(turns) and q in (0, 3):
            return cost, audit
        after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
        steps = [(costs.insert, "I", i, after[c]) for c in "ua" if c in after]
        if i < len(turns):
            initial, fault = turns[i]
            steps.append((costs.delete, "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                more = costs.truncated * (fault == "truncated")
                steps += [(more, "K", i + 1, after[initial])] if initial in after else []
                steps += [(costs.rerole + more, "R", i + 1, after[c]) for c in "ua" if c in after]
        for more, letter, j, r in steps:
            heapq.heappush(heap, (cost + more, audit + letter, j, r))


def test_cheapest_edits():
    rng = random.Random(4)
    for _ in range(80):
        turns = [(rng.choice(["s", "u", "a", " ", "t", ""]), rng.choice(FAULTS)) for _ in range(rng.randint(0, 5))]
        assert repair.finish(repair.piece(turns, repair.Costs(), (0,)))[1:] == every_edit(turns)


def test_pieces_join():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(0, 120)
        turns = [(rng.choice("suaua"), rng.choice(FAULTS)) for _ in range(n)]
        for costs in (repair.Costs(), repair.Costs(insert=1, delete=3), repair.Costs(1, 1, 1, 0)):
            want = search(turns, costs)
            assert repair.finish(repair.piece(turns, costs, (0,)))[1:] == want
            cuts = sorted(rng.randint(0, n) for _ in range(3))
            way = repair.Piece(0, {(0, 0): (0, 0)})
            for a, b in zip([0, *cuts], [*cuts, n], strict=True):
                part = repair.piece(turns[a:b], costs)
                way = way.then(repair.Piece.written({f"{p}{q}": part.read(p, q) for p, q in part.best}))
            assert repair.finish(way)[1:] == want


def test_long_conversation():
    rng = random.Random(6)
    turns = [(rng.choice("ua"), rng.choice(FAULTS)) for _ in range(20_000)]
    _, cost, audit = repair.finish(repair.piece(turns, repair.Costs(), (0,)))
    assert (cost, audit) == search(turns, repair.Costs())


def plain(rows, damage=True):
    """conv_id -> (figures, repaired lines) of rows (conv_id, turn, role, text)."""
    kept, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        kept[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else -1
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, turns in kept.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = search([(t[1][:1], f) for t, f in zip(turns, faults, strict=True)], repair.Costs())
        lines, i, roles = [], 0, ""
        for letter in audit:
            given = "u" if roles[-1:] in ("", "s", "a") else "a"
            if letter == "I":
                lines.append(({"u": "user", "a": "assistant"}[given], ""))
                roles += given
                continue
            _, role, text = turns[i]
            i += 1
            if letter == "K":
                lines.append((role, text))
                roles += role[:1]
            elif letter == "R":
                lines.append(({"u": "user", "a": "assistant"}[given], text))
                roles += given
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = ((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha), lines)
    return out


def table(rng, long=300):
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "no", "Why?  ", " \t", None, "ünï 漢!", f"{rng.random()}.", "a\nb"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    rows += [(100, i, rng.choice(["user", "assistant"]), rng.choice(["Hm.", f"{i}.", f"{i}", "x" * 3000])) for i in range(long)]
    rows += [(101, 5, "user", "Same.")] * 40 + [(102, None, "user", f"{i}.") for i in range(50)]
    return rows


COLUMNS = "conv_id long, turn long, role string, text string, n int, conv string, copies string, kind string, part string"


@pytest.mark.parametrize("spread", [False, True])
def test_repair_of_tables(spark, spread):
    rows = table(random.Random(7))
    df = spark.createDataFrame([(*r, 1, "c", "x", "k", "p") for r in rows], COLUMNS)
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"} if spread else {}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        want = plain(rows)
        got = repair.repair_report(df)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted((x[0] for x in want.values()), key=repr)
        summary, repaired = repair.repair(repair.turns_of(df))
        want = plain(rows, damage=False)
        assert sorted(map(tuple, summary.collect()), key=repr) == sorted((x[0] for x in want.values()), key=repr)
        lines = defaultdict(list)
        for r in sorted(repaired.collect(), key=lambda r: (repr(r.conv_id), r.part, r.pos)):
            lines[r.conv_id].append((r.role, r.text))
        assert {k: v for k, (_, v) in want.items() if v} == lines
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nothing_left_and_nothing_given(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair_report(df).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_report(df.where("turn > 0")).count() == 0
