"""Line dedup, Jaccard join and repeated phrases against plain versions."""

from __future__ import annotations

import hashlib
import random
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402

from newslens.llm import hashing, jaccard, lines, phrases  # noqa: E402
from newslens.llm.common import NO_ID  # noqa: E402


def ordered(rows):
    """Distinct documents in the order that the operators state."""
    from zlib import crc32

    key = lambda r: (NO_ID if r[0] is None else r[0], crc32((r[1] or "").encode()))
    return sorted({(i, t or "") for i, t in rows}, key=key)


def later_runs(rows, split, size):
    """For each document the positions covered by a run of `size` parts that starts earlier."""
    seen, gone = set(), {}
    for doc in ordered(rows):
        parts = split(doc[1])
        out = set()
        for s in range(len(parts) - size + 1):
            v = tuple(parts[s : s + size])
            if v in seen:
                out.update(range(s, s + size))
            seen.add(v)
        gone[doc] = out
    return gone


def repeated_lines(rows, window=lines.WINDOW, words=lines.WORDS):
    """For each document the lines that lie in a run that starts earlier and has enough lines or words: every match of two positions, extended."""
    seen, gone = defaultdict(list), {}
    for doc in ordered(rows):
        parts = doc[1].split("\n")
        out = set()
        for p, line in enumerate(parts):
            for other, q in seen[line] + [(parts, q) for q in range(p) if parts[q] == line]:
                if p and q and parts[p - 1] == other[q - 1]:
                    continue  # part of the match that starts before
                m = 0
                while p + m < len(parts) and q + m < len(other) and parts[p + m] == other[q + m]:
                    m += 1
                if m >= window or sum(len(cases.words_of(x)) for x in parts[p : p + m]) >= words:
                    out.update(range(p, p + m))
        for p, line in enumerate(parts):
            seen[line].append((parts, p))
        gone[doc] = out
    return gone


def test_line_runs(spark):
    rng = random.Random(31)
    long_line = "one two three four five six seven eight nine"
    rows = cases.odd_texts() + [(100, "a\nb\nc\nx\na\nb\nc"), (101, "a\nb\nc\nd"), (102, "b\nc\nd\n"), (103, "\n\n\n\n")]
    rows += [(110, long_line), (111, f"x\n{long_line}\ny"), (112, f"x\n{long_line}\nz"), (113, "q r s t\nu v w x y"), (114, "0\nq r s t\nu v w x y\n1"), (115, "u v w x y")]
    pool = ["p", "q r s", "t u v w", "", "a b c d e f", long_line, "g h i j k l m n", " "]
    rows += [(200 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    rows += [(300 + i, "\n".join(f"{rng.randint(0, 30)} {'w ' * rng.randint(0, 4)}" for _ in range(12))) for i in range(40)]
    for window, words in ((lines.WINDOW, lines.WORDS), (2, 5), (4, 12)):
        gone = repeated_lines(rows, window, words)
        want = sorted(
            (str(i), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(i, t)]) if gone[(i, t or "")] else t, len(gone[(i, t or "")]))
            for i, t in rows if t is not None
        )
        out = lines.dedup_lines(cases.frame(spark, rows), window, words, removed="removed")
        got = sorted((str(r.doc_id), r.text, r.removed) for r in out.collect() if r.text is not None)
        assert got == want
    assert out.columns == [*cases.frame(spark, rows).columns, "removed"]
    assert sum(r.text is None for r in out.collect()) == sum(t is None for _, t in rows)
    assert lines.dedup_lines(cases.frame(spark, [])).count() == 0


def test_many_lines_take_linear_time(spark):
    """A text of 250,000 lines that loses a run of 200,000 of them."""
    import time

    shared = [f"line {i}" for i in range(200_000)]
    rows = [(1, "\n".join(shared)), (2, "\n".join([*shared[:100], *[f"own {i}" for i in range(50_000)], *shared[100:]]))]
    docs = cases.frame(spark, rows)
    began = time.time()
    got = {r.doc_id: r for r in lines.dedup_lines(docs, removed="removed").select("doc_id", "text", "removed").collect()}
    assert time.time() - began < 60
    assert (got[1].removed, got[2].removed) == (0, 200_000) and got[2].text == "\n".join(f"own {i}" for i in range(50_000))


def test_phrases(spark):
    rows = cases.odd_texts() + [(200, " ".join(["again"] * 70)), (201, " ".join(["again"] * 30))]
    gone = later_runs(rows, cases.words_of, phrases.WINDOW)
    want = []
    for i, t in rows:
        g, w = gone[(i, t or "")], cases.words_of(t)
        want.append((str(i), len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in phrases.digests(cases.frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] for x in want) > 500
    assert phrases.digests(cases.frame(spark, [])).count() == 0


def shingles(text, k):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and (sets[a][0] == sets[b][0] or 100 * len(x & y) >= percent * len(x | y)):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 2**62)
    low = lambda i: NO_ID if i is None else i
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least[find(a)], low(i))
    return sorted((low(i), len(s), least[find(a)] if s else low(i)) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, percent):
    import random

    rng = random.Random(k)
    rows = cases.odd_texts(k)
    base = cases.prose(rng, 200).split(" ")
    for i in range(60):  # chains of edits around the threshold
        other = list(base)
        for _ in range(rng.randint(1, 7)):
            other[rng.randrange(len(other))] = cases.word(rng)
        rows.append((300 + i, " ".join(other)))
        if i % 3 == 0:
            base = other
    low = lambda x: NO_ID if x is None else x
    got = sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in jaccard.near_duplicates(cases.frame(spark, rows), k, percent).collect())
    assert got == plain_components(rows, k, percent)
    kept = jaccard.keep_one(cases.frame(spark, rows), k, percent)
    assert kept.columns == cases.frame(spark, []).columns
    want = sorted(i for i, _, c in plain_components(rows, k, percent) if i == c)
    assert sorted(low(r.doc_id) for r in kept.collect()) == want
    assert jaccard.near_duplicates(cases.frame(spark, []), k, percent).count() == 0


def test_jaccard_compares_a_group_of_near_copies_once(spark, monkeypatch):
    """Copies that combine a few edits have many centres, but each needs one of them; far ones and their copies are still found."""
    import itertools
    import random

    rng = random.Random(12)
    base = cases.prose(rng, 300).split(" ")
    edits = [[cases.word(rng) for _ in range(3)] for _ in range(4)]
    rows = []
    for n, picks in enumerate(itertools.product(range(3), repeat=4)):
        words = list(base)
        for place, (edit, k) in enumerate(zip(edits, picks, strict=True)):
            words[20 + 60 * place] = edit[k]
        rows.append((n, " ".join(words)))
    far = " ".join([*base[:150], *cases.prose(rng, 150).split(" ")])
    rows += [(500, far), (501, far + " end"), (502, cases.prose(rng, 300))]
    seen = []
    plain = jaccard.compared

    def counting(spokes, *more):
        seen.append(spokes.count())
        return plain(spokes, *more)

    monkeypatch.setattr(jaccard, "compared", counting)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(cases.frame(spark, rows), 3, 90).collect())
    assert got == plain_components(rows, 3, 90)
    assert sum(seen) <= 1.5 * len(rows)


def test_jaccard_pairs_of_a_family_follow_own_edits(spark, monkeypatch):
    """Copies that mix a stock of edits with their own share many edits and are rarely linked; few pairs of them are formed, and links are found."""
    rng = random.Random(21)
    base = cases.prose(rng, 300).split(" ")
    stock = {place: cases.word(rng) for place in range(5, 295, 7)}
    rows = []
    for n in range(150):
        words = [stock[k] if k in stock and rng.random() < 0.25 else w for k, w in enumerate(base)]
        for k in rng.sample(range(len(base)), 12):
            words[k] = cases.word(rng)
        rows.append((n, " ".join(words)))
        if n % 10 == 0:
            words[len(base) // 2] = cases.word(rng)
            rows.append((1000 + n, " ".join(words)))
    seen = []
    plain = jaccard.verified

    def counting(pairs, *more):
        seen.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(jaccard, "verified", counting)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(cases.frame(spark, rows), 5, 80).collect())
    assert got == plain_components(rows, 5, 80)
    assert sum(seen) <= 2 * len(rows)


def test_sets_hold_rare_shingles_first(spark):
    import numpy as np

    sets = {1: [-5, 2, 9], 2: [2, 7, 9], 3: [2, 9], 4: [9]}
    rows = [(c, np.array(t, np.int64).tobytes()) for c, t in sets.items()] + [(4, np.array([9], np.int64).tobytes())]
    got = jaccard.rare_first(spark.createDataFrame(rows, "class long, tokens binary")).collect()
    assert sorted((r["class"], np.frombuffer(r["tokens"], np.int64).tolist()) for r in got) == [(1, [-5, 2, 9]), (2, [7, 2, 9]), (3, [2, 9]), (4, [9]), (4, [9])]


def test_signatures_meet():
    """Any two sets within the threshold have signatures of a band in common, as many as each needs."""
    import numpy as np

    rng = np.random.default_rng(3)
    for percent in (80, 90, 95):
        bands = jaccard.Bands(percent)
        for _ in range(400):
            n = int(rng.integers(4, 160))
            x = rng.integers(0, 2**64, n, dtype=np.uint64)
            low = -(-percent * n // 100)
            shared = int(rng.integers(low, n + 1))
            new = max(0, 100 * shared // percent - n)
            y = np.concatenate([x[:shared], rng.integers(0, 2**64, new, dtype=np.uint64)])
            if shared == n and not new:
                continue
            assert 100 * shared >= percent * (n + new)
            mine, theirs = ({b[0]: (jaccard.signatures(s, *b), bands.need(len(s), b[0])) for b in bands.signed_for(len(s))} for s in (x, y))
            both = set(mine) & set(theirs)
            met = {b: len(np.intersect1d(mine[b][0][0], theirs[b][0][0])) for b in both}
            top = max(bands.of(len(x)), bands.of(len(y)))
            for side in (mine, theirs):
                (_, unsigned), need = side[top]
                assert met[top] >= max(1, need - unsigned), (percent, n, shared, new)


def test_word_hashes_are_exact():
    texts = [t or "" for _, t in cases.odd_texts()]
    h, bounds = hashing.word_hashes(texts)
    names = {}
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        w = cases.words_of(t)
        assert len(w) == b - a
        for x, y in zip(w, h[a:b].tolist(), strict=True):
            assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)


def test_texts_of_a_batch_are_hashed_in_small_parts():
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(300)) for _ in range(2500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    found = []
    for a, b, part in jaccard.sets(batch, 5):
        assert a == len(found) and sum(map(len, texts[a:b])) <= 1 << 20
        found += [np.array(t) for t in part]
    assert len(found) == len(texts)
    for i in (0, 1200, 2499):
        ((_, _, (alone,)),) = jaccard.sets(batch.slice(i, 1), 5)
        assert np.array_equal(found[i], alone)
