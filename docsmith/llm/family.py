"""A logarithmic family of sorted arrays: new batches are scanned against the levels, equal levels merge.

An entry stands for a suffix: ``key`` is what suffixes are ordered by first, ``sub``
tells apart entries of one key, ``owner`` is the batch.  Adding a batch of sorted
entries merge-scans it against every level (binary searches for the few keys that
meet, so a scan costs as the batch, not as the level) and marks matches on both
sides.  Then levels of a size merge, as in a binary counter, so n batches leave about
log n levels and an entry is moved log n times.  Every entry has all its marks at any
time, so levels need not be brought together to be read, and a family can be kept and taken up again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .common import ragged

#: Marks: the same key and sub elsewhere; another sub of the key elsewhere; the first of its key and sub; windows given already. Others pass through.
REPEATED, CONTESTED, FIRST, GIVEN = 1, 2, 4, 8


def pair_index(keys: np.ndarray, subs: np.ndarray, key: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (key, sub): the range of the key in the sorted keys, and the place of the pair or -1."""
    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    place = np.full(len(key), -1, np.int64)
    at = np.flatnonzero(hi > lo)
    a, b, want = lo[at], hi[at], sub[at]
    while (open_ := a < b).any():
        mid = (a + b) // 2
        less = open_ & (subs[np.minimum(mid, len(subs) - 1)] < want)
        b = np.where(open_ & ~less, mid, b)
        a = np.where(less, mid + 1, a)
    inside = a < hi[at]
    found = at[inside][subs[a[inside]] == want[inside]]
    place[at[inside]] = a[inside]
    keep = np.zeros(len(key), bool)
    keep[found] = True
    place[~keep] = -1
    return lo, hi, place


@dataclass
class Level:
    key: np.ndarray
    sub: np.ndarray
    owner: np.ndarray
    mark: np.ndarray

    @classmethod
    def merged(cls, a: Level, b: Level) -> Level:
        parts = [np.concatenate([getattr(a, c), getattr(b, c)]) for c in ("key", "sub", "owner", "mark")]
        order = np.lexsort((parts[1], parts[0]))
        return cls(*(p[order] for p in parts))


@dataclass
class Family:
    levels: list[Level] = field(default_factory=list)

    def scan(self, new: Level, level: Level) -> None:
        """Mark what matches between a new batch and a level."""
        lo, hi, place = pair_index(level.key, level.sub, new.key, new.sub)
        same = np.flatnonzero(place >= 0)
        new.mark[same] = new.mark[same] & ~np.uint8(FIRST) | REPEATED
        level.mark[place[same]] |= REPEATED
        met = np.flatnonzero(hi > lo)
        differ = met[(level.sub[lo[met]] != new.sub[met]) | (level.sub[hi[met] - 1] != new.sub[met])]
        new.mark[differ] |= CONTESTED
        # a level's entries of one key are contested all or none
        fresh = differ[level.mark[lo[differ]] & CONTESTED == 0]
        level.mark[ragged(lo[fresh], hi[fresh] - lo[fresh])] |= CONTESTED

    def add(self, key: np.ndarray, sub: np.ndarray, mark: np.ndarray, owner: int) -> np.ndarray:
        """Add a batch, sorted by key and sub, each pair once; returns its marks so far."""
        new = Level(key, sub, np.full(len(key), owner, np.int32), mark | np.uint8(FIRST))
        if not len(key):
            return new.mark
        for level in self.levels:
            self.scan(new, level)
        marks = new.mark
        while self.levels and len(self.levels[-1].key).bit_length() <= len(new.key).bit_length():
            new = Level.merged(self.levels.pop(), new)
        self.levels.append(new)
        return marks

    def marked(self, wanted: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, key, sub, mark) of the entries that carry a wanted mark, level by level."""
        for level in self.levels:
            keep = np.flatnonzero(level.mark & wanted)
            keep = keep[np.argsort(level.owner[keep], kind="stable")]
            owners, first = np.unique(level.owner[keep], return_index=True)
            for owner, at in zip(owners.tolist(), np.split(keep, first[1:])):
                yield owner, level.key[at], level.sub[at], level.mark[at]

    def all(self) -> Level:
        """One level of everything."""
        if not self.levels:
            none = np.zeros(0, np.uint64)
            return Level(none, none, np.zeros(0, np.int32), np.zeros(0, np.uint8))
        out = self.levels[0]
        for level in self.levels[1:]:
            out = Level.merged(out, level)
        self.levels = [out]
        return out


def batch_entries(key: np.ndarray, sub: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, sub) of a batch in order, with their marks and those that the batch itself gives."""
    order = np.lexsort((sub, key))
    key, sub, mark = key[order], sub[order], mark[order].astype(np.uint8)
    if not len(key):
        return key, sub, mark
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.concatenate([at, [len(key)]]))
    mark = np.bitwise_or.reduceat(mark, at) | np.where(count > 1, REPEATED, 0).astype(np.uint8)
    key, sub = key[at], sub[at]
    same = key[1:] == key[:-1]
    mark[1:][same] |= CONTESTED
    mark[:-1][same] |= CONTESTED
    return key, sub, mark
