"""Anchors: where a repeated string of ``WINDOW`` bytes can lie, told from content alone.

Every window of ``WINDOW`` bytes has an anchor, the least hash of the ``GRAM``-byte strings in it. Equal
windows have equal anchors at equal offsets. Consecutive windows with one anchor form a run. Runs
whose anchor is found at one place only can't hold a repeated window; the rest are grouped by
their anchor, and windows of different groups can't be equal.

A group that is too large is refined: the windows of its segments are cut into runs again, now by the ``level`` + 1 least
hashes of their grams, which equal windows have in common too.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 200, 32
_SPAN = WINDOW - GRAM + 1  # grams of a window

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for m in (_MULT, _INVERSE):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte string of ``data`` (u8) that hangs on its bytes alone."""
    n = len(data)
    up, down = _tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    z = (total[GRAM:] - total[: n - GRAM + 1]) * down[: n - GRAM + 1]
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` consecutive entries."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, its runs: (anchor, first window, windows, places of the anchor)."""
    none = (np.zeros(0, np.int64),) * 4
    out = [none] * len(texts)
    at, batch = 0, []
    for i, t in enumerate(texts):
        if len(t) >= WINDOW:
            batch.append(i)
            at += len(t)
        if batch and (at > 2_000_000 or i == len(texts) - 1):
            for j, r in zip(batch, _runs([texts[j] for j in batch]), strict=True):
                out[j] = r
            at, batch = 0, []
    if batch:
        for j, r in zip(batch, _runs([texts[j] for j in batch]), strict=True):
            out[j] = r
    return out


def _runs(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    least = _sliding(h, _SPAN, np.minimum)
    of = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    inside = np.arange(len(least)) + WINDOW <= starts[of + 1]
    # places of anchors: grams that are the least of some window they lie in
    padded = np.concatenate((np.zeros(_SPAN - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(_SPAN - 1, np.uint64)))
    place = np.flatnonzero((_sliding(padded, _SPAN, np.maximum)[: len(h)] == h) & (h > 0))
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    gone = np.flatnonzero(~inside)
    stop = np.append(first[1:], len(least))
    after = np.searchsorted(gone, first)
    stop = np.minimum(stop, np.append(gone, len(least))[after])
    count = stop - first
    anchor = least[first]
    # places of a run's anchor within the run's grams
    code = np.unique(np.concatenate((h[place], anchor)), return_inverse=True)[1]
    n = np.int64(len(h) + 1)
    keyed = np.sort(code[: len(place)] * n + place)
    base = code[len(place) :] * n
    places = np.searchsorted(keyed, base + stop - 1 + _SPAN) - np.searchsorted(keyed, base + first)
    text = of[first]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    signed = anchor.view(np.int64)
    return [(signed[a:b], first[a:b] - starts[i], count[a:b], places[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def refined(data: bytes, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, key) of the runs of windows of ``data`` that agree in their ``level`` + 1 least gram hashes.

    Equal windows have equal keys, and with all of its grams' hashes a key tells the window itself.
    """
    h = gram_hashes(np.frombuffer(data, np.uint8))
    n = len(h) - _SPAN + 1
    firsts, counts, keys = [], [], []
    for lo in range(0, n, 2048):  # bounded memory
        view = np.lib.stride_tricks.sliding_window_view(h[lo : lo + 2048 + _SPAN - 1], _SPAN)
        most = min(level + 1, _SPAN)
        least = np.sort(np.partition(view, most - 1, axis=1)[:, :most] if most < _SPAN else view, axis=1)
        key = np.zeros(len(least), np.uint64)
        for c in range(most):
            key = (key ^ least[:, c]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        firsts.append(edge + lo)
        counts.append(np.diff(np.append(edge, len(key))))
        keys.append(key[edge])
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(keys).view(np.int64)
