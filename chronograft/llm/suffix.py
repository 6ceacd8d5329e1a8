"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays.

A suffix is S (smaller than the one after it) or L (larger). Leftmost S suffixes (LMS) cut the
text into substrings; sorting those, by induction from their first characters, names them; the
text of names is sorted recursively, which sorts the LMS suffixes; all others are induced from
them in two scans. With few distinct characters a scan works on whole buckets at a time and is
linear. The text of names has too many buckets for that; there a scan ranks the falling, then the
rising runs, by doubling along the run.
"""

from __future__ import annotations

import numpy as np


#: Characters that all positions are compared by together; longer matches are followed one by one.
_STEPS = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S. The last character has to be the only least one."""
    n = len(t)
    rises = np.ones(n, bool)
    rises[:-1] = t[:-1] < t[1:]
    settled = np.ones(n, bool)
    settled[:-1] = t[:-1] != t[1:]
    at = np.where(settled, np.arange(n), n)
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


class _Buckets:
    """Lists of entries by character, filled from arrays in order."""

    def __init__(self, t: np.ndarray, k: int):
        self.t, self.parts = t, [[] for _ in range(k)]

    def push(self, entries: np.ndarray) -> None:
        if not len(entries):
            return
        chars = self.t[entries]
        order = np.argsort(chars, kind="stable")
        entries, chars = entries[order], chars[order]
        cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for a, b, c in zip(starts, [*starts[1:], len(entries)], chars[starts].tolist(), strict=True):
            self.parts[c].append(entries[a:b])

    def take(self, c: int) -> np.ndarray:
        parts, self.parts[c] = self.parts[c], []
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _waves(first: np.ndarray, c: int, t: np.ndarray, mine: np.ndarray, out: _Buckets) -> np.ndarray:
    """All entries of bucket ``c`` that follow from ``first``, pushing what they induce elsewhere."""
    waves = []
    while len(first):
        waves.append(first)
        before = first[first > 0] - 1
        before = before[mine[before]]
        same = t[before] == c
        out.push(before[~same])
        first = before[same]
    return np.concatenate(waves) if waves else np.zeros(0, np.int32)


def _induced(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes that follows from the order of the LMS ones (by bucket at least)."""
    n, is_l = len(t), ~is_s
    seeds = _Buckets(t, k)
    seeds.push(lms)
    larger, smaller = _Buckets(t, k), _Buckets(t, k)
    l_of, s_of = [None] * k, [None] * k
    for c in range(k):
        l_of[c] = _waves(larger.take(c), c, t, is_l, larger)
        larger.push(seeds.take(c) - 1)  # what precedes an LMS suffix is L
    smaller.push(np.array([n - 1], np.int32))
    for c in range(k - 1, -1, -1):
        s_of[c] = _waves(smaller.take(c), c, t, is_s, smaller)[::-1]
        back = l_of[c][::-1]
        back = back[back > 0] - 1
        smaller.push(back[is_s[back]])
    return np.concatenate([x for c in range(k) for x in (l_of[c], s_of[c])])


def _names(t: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each LMS substring, in sorted order, differs from the one before it."""
    a, b = order[:-1], order[1:]
    la, lb = length[a], length[b]
    differs = la != lb
    live = np.flatnonzero(~differs)
    d = 0
    while len(live):
        unequal = t[a[live] + d] != t[b[live] + d]
        differs[live[unequal]] = True
        d += 1
        live = live[~unequal & (la[live] > d)]
    return np.concatenate(([True], differs))


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of ``t``, integers from 0 to k - 1 whose last one is 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    is_s = _types(t)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    order = _induced(t, is_s, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    length = np.zeros(n, np.int32)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    name = np.cumsum(_names(t, order, length)) - 1
    if name[-1] + 1 < len(lms):
        named = np.zeros(n, np.int32)
        named[order] = name
        order = lms[np.argsort(_by_runs(named[lms].astype(np.int64)))]
    return _induced(t, is_s, order, k)


def _dense(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Ranks from 0 of pairs of non-negative numbers, equal pairs sharing one."""
    return np.unique(major * (int(minor.max(initial=0)) + 1) + minor, return_inverse=True)[1]


def _along_runs(code: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Ranks of the runs that start at each entry, a run going on by ``step`` until it stays.

    A rank is the number of smaller runs. A run's rank is refined by that of the run twice as far
    on, so rounds are the logarithm of the longest run; a round sorts only runs that still tie.
    """
    counts = np.bincount(code)
    rank = (np.cumsum(counts) - counts)[code]
    live = np.flatnonzero((counts[code] > 1) & (step != np.arange(len(step))))
    while len(live):
        a, b = rank[live], rank[step[live]]
        order = np.argsort(a * len(rank) + b)
        live, a, b = live[order], a[order], b[order]
        at = np.arange(len(live))
        new_a = np.append(True, a[1:] != a[:-1])
        new = new_a | np.append(True, b[1:] != b[:-1])
        rank[live] = a + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_a, at, 0))
        ties = ~(new & np.append(new[1:], True))
        further = step[step]
        live = live[ties & (further[live] != step[live])]
        step = further
    return rank


def _ranks(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, lms_rank: np.ndarray) -> np.ndarray:
    """Induced ranks of all suffixes; suffixes that are equal up to equal LMS ranks share one.

    An L suffix is its falling run of characters and then the LMS suffix that ends it; an S suffix
    is its rising run and then an L suffix. Both scans thus rank runs.
    """
    n = len(t)
    last = np.zeros(n, np.int64)
    last[lms] = lms_rank + 1
    taken = ~is_s
    taken[lms] = True
    some = np.flatnonzero(taken)
    at = np.cumsum(taken) - 1
    step = np.where(is_s[some], np.arange(len(some)), np.minimum(at[some] + 1, len(some) - 1))
    larger = np.zeros(n, np.int64)
    larger[some] = _along_runs(_dense(t[some] * 2 + is_s[some], last[some]), step)
    step = np.where(is_s, np.arange(1, n + 1), np.arange(n))
    step[n - 1] = n - 1
    return _along_runs(_dense(t * 2 + is_s, np.where(is_s, 0, larger + 1)), step)


def _by_runs(t: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a text of many names."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    name = np.unique(_ranks(t, is_s, lms, np.zeros(len(lms), np.int64))[lms], return_inverse=True)[1]
    if name.max(initial=0) + 1 < len(lms):
        name = _by_runs(name)
    return _ranks(t, is_s, lms, name)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the length of the prefix it shares with the suffix sorted before it.

    In text order the values fall by at most one from a position to the next, and by exactly one
    wherever the preceding suffix moves along too; only the other positions are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    moved = np.ones(n, bool)
    moved[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (t[:-1] != t[np.maximum(before[:-1], 0)])
    start = np.flatnonzero(moved & (before >= 0))
    other = before[start]
    length = np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    room = n - np.maximum(start, other)
    d = 0
    while len(live) and d < _STEPS:
        equal = t[start[live] + d] == t[other[live] + d]
        length[live[equal]] = d + 1
        d += 1
        live = live[equal & (room[live] > d)]
    for i in live.tolist():  # few; what is compared here is passed over by the positions that follow
        a, b, most = int(start[i]), int(other[i]), int(room[i])
        while d < most:
            size = min(1 << 14, most - d)
            unequal = np.flatnonzero(t[a + d : a + d + size] != t[b + d : b + d + size])
            if len(unequal):
                d += int(unequal[0])
                break
            d += size
        length[i], d = d, _STEPS
    out = np.zeros(n, np.int64)
    out[start] = length
    anchor = np.where(moved, np.arange(n), 0)
    anchor = np.maximum.accumulate(anchor)
    return np.maximum(out[anchor] - (np.arange(n) - anchor), 0)
