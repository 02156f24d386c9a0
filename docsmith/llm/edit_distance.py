"""Edit distance within a threshold, bit-parallel over a band, for many pairs at once.

The band of 2 k + 1 diagonals around the main one is a few bits of a word (Hyyro's
banded form of Myers' algorithm): bit r of column j stands for row j - k + r.  All pairs
advance a column together; the score follows the lowest diagonal until it meets
the last row, and then that row.
"""

from __future__ import annotations

import numpy as np


def within(text: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, k: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Whether text[a:a + m] and text[b:b + n] are at most k edits apart, for arrays of pairs; ``limit`` gives each pair a bound of its own, k at most."""
    out = np.zeros(len(a), bool)
    limit = np.full(len(a), k, np.int64) if limit is None else limit
    todo = np.flatnonzero(np.abs(m - n) <= limit)
    todo = todo[np.argsort(-n[todo], kind="stable")]
    for c in range(0, len(todo), 1 << 14):
        part = todo[c : c + (1 << 14)]
        own = [x[part].astype(np.int64) for x in (a, m, b, n)]
        _trim(text, *own)
        order = np.argsort(-own[3], kind="stable")
        out[part[order]] = _columns(text, *(x[order] for x in own), k) <= limit[part[order]]
    return out


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int, width: int = 32) -> np.ndarray:
    """How many characters of each pair are equal from a and b on, forwards or backwards, up to size."""
    out = np.zeros(len(a), np.int64)
    on = np.flatnonzero(size > 0)
    ahead = np.arange(width)
    while len(on):
        done, left = out[on], size[on] - out[on]
        at = np.minimum(ahead, left[:, None] - 1) + done[:, None]
        same = text[a[on, None] + step * at] == text[b[on, None] + step * at]
        run = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), left)
        out[on] += run
        on = on[(run == width) & (left > width)]
    return out


def _trim(text: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
    """Leave out the equal starts and ends of the pairs, which cost nothing; of near copies little stays."""
    same = _equal(text, a, b, np.minimum(m, n), 1)
    a += same
    b += same
    m -= same
    n -= same
    same = _equal(text, a + m - 1, b + n - 1, np.minimum(m, n), -1)
    m -= same
    n -= same


def _columns(text: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Scores of pairs in descending order of n; above k they may be too large, never too small."""
    mask = (1 << 2 * k + 1) - 1
    high = np.int64(2 * k)
    # rows up to 0 are a flat start: every column adds one there
    vp = np.full(len(a), 0, np.int64)
    for r in range(k, 2 * k + 1):
        vp |= 1 << r
    vn = np.zeros(len(a), np.int64)
    score = np.minimum(m, k)
    last = len(text) - 1
    for j in range(1, int(n.max(initial=0)) + 1):
        on = int(np.searchsorted(-n, -j, "right"))
        if on < len(a):
            a, m, b, n, vp, vn = a[:on], m[:on], b[:on], n[:on], vp[:on], vn[:on]
        now = text[b + j - 1]
        eq = np.zeros(on, np.int64)
        for r in range(2 * k + 1):
            i = j - k + r
            if i > 0:
                eq |= ((text[np.minimum(a + i - 1, last)] == now) & (i <= m)).astype(np.int64) << r
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        row = m - j + k
        along = row >= high
        at = np.clip(row, 0, 62)
        score[:on] += np.where(along, 1 - (d0 >> high & 1), (hp >> at & 1) - (hn >> at & 1))
        down = d0 >> 1
        vp = (hn | ~(down | hp)) & mask
        vn = hp & down
    return score
