"""Suffix arrays of byte strings by induced sorting, in array operations.

Suffixes are classified as smaller or larger than their successors; the leftmost-smaller ones are sorted by their
substrings, and by doubling the names where they repeat; the others are induced from them in one pass up and one pass
down the buckets. The passes are linear in the bytes; the doubling sorts, so it is not.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; ``s`` ends with a unique smallest value."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32))
    step[-1] = 1
    known = np.where(step != 0, np.arange(n), n)
    follows = np.minimum.accumulate(known[::-1])[::-1]
    return step[follows] > 0


def _deal(found: np.ndarray, keys: np.ndarray, waiting: list[list[np.ndarray]]) -> None:
    """Append ``found`` to the buckets of ``keys``, keeping its order within each."""
    if not len(found):
        return
    order = np.argsort(keys, kind="stable")
    found, keys = found[order], keys[order]
    edges = np.flatnonzero(np.diff(keys)) + 1
    for part, key in zip(np.split(found, edges), keys[np.concatenate([[0], edges])], strict=True):
        waiting[key].append(part)


def _induced(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the leftmost-smaller suffixes ``seeds`` induce."""
    size = int(s.max()) + 1
    first: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(seeds, s[seeds], first)
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]

    def before(now: np.ndarray, kind: bool) -> np.ndarray:
        ahead = now[now > 0] - 1
        return ahead[smaller[ahead] == kind]

    for c in range(size):
        turn = larger[c]
        larger[c] = []
        now = np.concatenate(turn) if turn else np.empty(0, np.int64)
        while len(now):
            larger[c].append(now)
            ahead = before(now, False)
            same = s[ahead] == c
            _deal(ahead[~same], s[ahead[~same]], larger)
            now = ahead[same]
        for now in first[c]:
            ahead = before(now, False)
            _deal(ahead, s[ahead], larger)
    lesser: list[list[np.ndarray]] = [[] for _ in range(size)]
    lesser[0].append(np.array([len(s) - 1], np.int64))
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        turn = lesser[c]
        lesser[c] = []
        now = np.concatenate(turn) if turn else np.empty(0, np.int64)
        while len(now):
            lesser[c].append(now)
            if c == 0:
                break
            ahead = before(now, True)
            same = s[ahead] == c
            _deal(ahead[~same], s[ahead[~same]], lesser)
            now = ahead[same]
        for now in reversed(larger[c]):
            ahead = before(now[::-1], True)
            _deal(ahead, s[ahead], lesser)
        out += lesser[c]
        out += [part[::-1] for part in reversed(larger[c])]
    return np.concatenate(out)[::-1]


def _names(s: np.ndarray, ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names, in sorted order, of the substrings from ``ordered`` to the next leftmost-smaller position."""
    length = ends[ordered] - ordered + 1
    equal = np.zeros(len(ordered), bool)
    equal[1:] = length[1:] == length[:-1]
    active, at = np.flatnonzero(equal), 0
    while len(active):
        a, b = ordered[active], ordered[active - 1]
        same = s[a + at] == s[b + at]
        equal[active[~same]] = False
        at += 1
        active = active[same & (length[active] > at)]
    return np.cumsum(~equal) - 1


def _ranked(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: pairs of names are named again until all differ."""
    n, step, rank = len(names), 1, names.astype(np.int64)
    while True:
        key = (rank + 1) * (n + 2)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, bool)
        fresh[0], fresh[1:] = True, np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


def suffix_array(data: bytes) -> np.ndarray:
    """Start positions of all suffixes of ``data`` in order."""
    if not data:
        return np.empty(0, np.int64)
    s = np.zeros(len(data) + 1, np.int16)
    s[:-1] = np.frombuffer(data, np.uint8)
    s[:-1] += 1
    smaller = classify(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.full(len(s), len(s) - 1, np.int64)
    ends[leftmost[:-1]] = leftmost[1:]
    marked = np.zeros(len(s), bool)
    marked[leftmost] = True
    rough = _induced(s, smaller, leftmost)
    ordered = rough[marked[rough]]
    named = _names(s, ordered, ends)
    if named[-1] + 1 < len(named):
        place = np.empty(len(s), np.int64)
        place[ordered] = named
        ordered = leftmost[_ranked(place[leftmost])]
    return _induced(s, smaller, ordered)[1:]


def agrees(data: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix of ``order`` shares ``length`` bytes with the one before it; all have as many.

    Neighbours are compared eight bytes at a time; lengths of common prefixes are not computed.
    """
    n = len(data)
    padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    eight = padded[:n].copy()
    for k in range(1, 8):
        eight |= padded[k : n + k] << np.uint64(8 * k)
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    active = np.flatnonzero(previous >= 0)
    shared = np.zeros(n, bool)
    shared[active] = True
    starts = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for at in starts:
        same = eight[active + at] == eight[previous[active] + at]
        shared[active[~same]] = False
        active = active[same]
    return shared[order]
