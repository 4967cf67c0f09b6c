"""Hashes of words and word runs for whole blocks of texts at once, inside a task."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 21
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Seeds of the hash; a change makes fingerprints of earlier runs incomparable.
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... (n numbers at least) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, CHUNK), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _chunk_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a byte buffer that ends in white space."""
    space = SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * powers(_BASE, len(buf))[: len(buf)])])
    value = (total[end] - total[start]) * powers(inverse(_BASE), len(buf))[start]
    return mixed(value + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+` of the texts, and where each text's words begin (one more number at the end).

    `lower` turns A-Z into a-z first. Long texts are worked off in chunks that end at white space.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    joined = b"\n".join(raw) + b"\n"
    if lower:
        joined = joined.lower()
    buf, hashes, firsts, at = np.frombuffer(joined, np.uint8), [], [], 0
    while at < len(buf):
        stop = min(len(buf), at + CHUNK)
        if stop < len(buf):
            cut = np.flatnonzero(SPACE[buf[at:stop]])
            if len(cut):
                stop = at + int(cut[-1]) + 1
            else:
                more = stop
                while not SPACE[buf[more]]:
                    more += 1
                stop = more + 1
        h, s = _chunk_hashes(buf[at:stop])
        hashes.append(h)
        firsts.append(s + at)
        at = stop
    h, s = (np.concatenate(x) for x in (hashes, firsts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return h, np.concatenate([[0], np.searchsorted(s, ends)]) if raw else np.zeros(1, np.int64)


class Runs:
    """Hashes of any run of consecutive words in constant time."""

    def __init__(self, words: np.ndarray):
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(_WORD_BASE, len(words) + 1)[: len(words)])])
        self.back = powers(inverse(_WORD_BASE), len(words) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `k` words of each text, and the number of the text; a text with fewer words has its whole sequence as one."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][owner]
    return Runs(words).hash(first, np.minimum(first + k, bounds[1:][owner])), owner


def distinct_shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of each text in ascending order, and the number of the text."""
    h, owner = shingles(words, bounds, k)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], owner[keep]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
