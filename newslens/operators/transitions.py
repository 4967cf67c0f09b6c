"""Subscriptions as functions of the state before them, which can be composed.

What a run of events does to a subscriber depends on little of the state before it: whether there is a subscriber, whether it has confirmed and
left, and where the time of its last confirmation mail lies among a few thresholds. `Transfer` has a row for each such case: the kind of state, an
interval of that time, and the state after the run, in which single fields may still be those given. The rows are arrays, so an event moves
all cases at once; cases that come to the same end are joined. Two transfers compose into that of both runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Actions, outcomes and the life of a confirmation link.
SUBSCRIBE, CONFIRM, UNSUBSCRIBE, PURGE = "subscribe", "confirm", "unsubscribe", "purge"
TTL_SECONDS = 7 * 24 * 3600

#: A field without a value, and one that is as it was before the run. Times lie between LOW and HIGH.
NONE, GIVEN = -(2**63), -(2**63) + 1
LOW, HIGH = -(2**62), 2**62
FIELDS = ["kind", "lo", "hi", "present", "confirmed_at", "unsubscribed_at", "sent_at"]

#: confirmed_at, unsubscribed_at, sent_at of a subscriber; None where there is no subscriber.
Row = tuple[int | None, int | None, int | None]


@dataclass(frozen=True)
class Rules:
    """Wait before a confirmation is sent again, and how long one is valid."""

    resend_seconds: int
    ttl_seconds: int = TTL_SECONDS


def advance(row: Row | None, action: str, us: int, rules: Rules) -> tuple[Row | None, str]:
    """State after one event, None when there is no subscriber, and the event's outcome."""
    confirmed, unsubscribed, sent = row or (None, None, None)
    pending = row is not None and confirmed is None
    if action == SUBSCRIBE:
        if row and confirmed is not None and unsubscribed is None:
            return row, "already_active"
        if row and sent >= us - rules.resend_seconds * 1_000_000:
            return row, "throttled"
        return (None, None, us), "needs_confirmation"
    if action == CONFIRM:
        valid = pending and sent > us - rules.ttl_seconds * 1_000_000
        return ((us, None, sent), "confirmed") if valid else (row, "confirm_failed")
    if action == UNSUBSCRIBE:
        return ((confirmed, us, sent), "unsubscribed") if row and unsubscribed is None else (row, "unchanged")
    if action == PURGE and pending and sent < us - rules.ttl_seconds * 1_000_000:
        return None, "purged"
    return row, "kept"


def kind_of(present, confirmed, unsubscribed):
    """0 for no subscriber, else 1 to 4 by whether it has confirmed and left."""
    return np.where(present == 0, 0, 1 + 2 * (confirmed != NONE) + (unsubscribed != NONE))


class Transfer:
    """State after a run of events for every state before it, one case per row of the arrays FIELDS."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.rows = rows

    @classmethod
    def nothing(cls) -> Transfer:
        """The run of no events: every state stays."""
        kind = np.arange(5, dtype=np.int64)
        given = np.full(5, GIVEN, np.int64)
        return cls({
            "kind": kind, "lo": np.full(5, LOW), "hi": np.full(5, HIGH), "present": (kind > 0).astype(np.int64),
            "confirmed_at": np.where(kind >= 3, given, NONE), "unsubscribed_at": np.where((kind == 2) | (kind == 4), given, NONE),
            "sent_at": np.where(kind > 0, given, NONE),
        })

    @classmethod
    def of(cls, us: list[int], actions: list[str], rules: Rules, tidy: int = 128) -> Transfer:
        out = cls.nothing()
        for i, (t, a) in enumerate(zip(us, actions, strict=True), 1):
            out._event(t, a, rules)
            if i % tidy == 0:
                out._tidy()
        return out._tidy()

    def _split(self, at: int, where: np.ndarray) -> None:
        """Cuts the cases of `where` whose time is still the one given, at a threshold within their interval."""
        r = self.rows
        cut = np.flatnonzero(where & (r["sent_at"] == GIVEN) & (r["lo"] < at) & (at < r["hi"]))
        if len(cut):
            lower = {f: r[f][cut] for f in FIELDS}
            r["lo"][cut] = at
            self.rows = {f: np.append(r[f], np.full(len(cut), at) if f == "hi" else lower[f]) for f in FIELDS}

    def _from(self, at: int) -> np.ndarray:
        """Whether the time of the last mail is `at` or later; clear for every case after a split there."""
        r = self.rows
        return np.where(r["sent_at"] == GIVEN, r["lo"] >= at, r["sent_at"] >= at)

    def _event(self, us: int, action: str, rules: Rules) -> None:
        def waiting() -> np.ndarray:
            return (self.rows["present"] == 1) & (self.rows["confirmed_at"] == NONE)

        def set_(where: np.ndarray, **values: int) -> None:
            for f, v in values.items():
                self.rows[f][where] = v

        expiry = us - rules.ttl_seconds * 1_000_000
        if action == SUBSCRIBE:
            def able() -> np.ndarray:
                r = self.rows
                return (r["present"] == 0) | (r["confirmed_at"] == NONE) | (r["unsubscribed_at"] != NONE)

            at = us - rules.resend_seconds * 1_000_000
            self._split(at, able())
            set_(able() & ((self.rows["present"] == 0) | ~self._from(at)), present=1, confirmed_at=NONE, unsubscribed_at=NONE, sent_at=us)
        elif action == CONFIRM:
            self._split(expiry + 1, waiting())
            set_(waiting() & self._from(expiry + 1), confirmed_at=us, unsubscribed_at=NONE)
        elif action == UNSUBSCRIBE:
            set_((self.rows["present"] == 1) & (self.rows["unsubscribed_at"] == NONE), unsubscribed_at=us)
        elif action == PURGE:
            self._split(expiry, waiting())
            set_(waiting() & ~self._from(expiry), present=0, confirmed_at=NONE, unsubscribed_at=NONE, sent_at=NONE)

    def _tidy(self) -> Transfer:
        """Joins neighbouring cases of one kind with one end."""
        order = np.lexsort((self.rows["lo"], self.rows["kind"]))
        r = {f: self.rows[f][order] for f in FIELDS}
        same = [r[f][1:] == r[f][:-1] for f in FIELDS if f not in ("lo", "hi")]
        first = np.flatnonzero(np.append(True, ~np.logical_and.reduce(same)))
        last = np.append(first[1:], len(order)) - 1
        self.rows = {f: r[f][last if f == "hi" else first].astype(np.int64) for f in FIELDS}
        return self

    def case(self, kind: int, sent: int) -> int:
        """The row for a state; `sent` is any number where there is no subscriber."""
        r = self.rows
        a, b = np.searchsorted(r["kind"], [kind, kind + 1])
        return int(a + np.searchsorted(r["lo"][a:b], sent if kind else LOW, side="right") - 1)

    def apply(self, row: Row | None) -> Row | None:
        values = dict(zip(FIELDS[4:], (NONE if v is None else v for v in row or (None, None, None)), strict=True))
        kind = 0 if row is None else 1 + 2 * (row[0] is not None) + (row[1] is not None)
        i = self.case(kind, values["sent_at"])
        if not self.rows["present"][i]:
            return None
        after = [values[f] if self.rows[f][i] == GIVEN else int(self.rows[f][i]) for f in FIELDS[4:]]
        return tuple(None if v == NONE else v for v in after)

    def then(self, after: Transfer) -> Transfer:
        """The transfer of this run and a later one."""
        mine, theirs = self.rows, after.rows
        kinds = kind_of(mine["present"], mine["confirmed_at"], mine["unsubscribed_at"])
        bounds = np.searchsorted(theirs["kind"], np.arange(6))
        own, other, lo, hi = [], [], [], []
        for i, (kind, sent) in enumerate(zip(kinds.tolist(), mine["sent_at"].tolist(), strict=True)):
            if kind == 0 or sent != GIVEN:
                cases = [after.case(kind, sent)]
            else:
                a, b = bounds[kind], bounds[kind + 1]
                first = a + np.searchsorted(theirs["lo"][a:b], mine["lo"][i], side="right") - 1
                cases = range(first, a + np.searchsorted(theirs["lo"][a:b], mine["hi"][i], side="left"))
            for j in cases:
                free = kind and sent == GIVEN
                own.append(i)
                other.append(j)
                lo.append(max(mine["lo"][i], theirs["lo"][j]) if free else mine["lo"][i])
                hi.append(min(mine["hi"][i], theirs["hi"][j]) if free else mine["hi"][i])
        rows = {"kind": mine["kind"][own], "lo": np.array(lo), "hi": np.array(hi), "present": theirs["present"][other]}
        for f in FIELDS[4:]:
            rows[f] = np.where(theirs[f][other] == GIVEN, mine[f][own], theirs[f][other])
        return Transfer(rows)._tidy()


def composed(transfers: list[Transfer]) -> Transfer:
    """Neighbours two by two, so that the work is that of the largest cases once per level."""
    level = transfers or [Transfer.nothing()]
    while len(level) > 1:
        level = [level[i].then(level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]
