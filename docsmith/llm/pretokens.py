"""Where pretokens start, for the two byte-level vocabularies, by array operations over UTF-8 bytes."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points of White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def kinds() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[SPACES] = SPACE
    return out


UNKNOWN, JOINS = 1, 2


@cache
def oddities() -> np.ndarray:
    """For every code point: UNKNOWN where Python's tables do not have it (a library with newer tables may), JOINS where composition may change it or what it follows."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    category, decomposition, normalize = unicodedata.category, unicodedata.decomposition, unicodedata.normalize
    for c in range(0x80, sys.maxunicode + 1):
        kind = category(char := chr(c))
        if kind == "Cn":
            out[c] = UNKNOWN
        elif kind[0] == "M" or ((parts := decomposition(char)) and parts[0] != "<" and normalize("NFC", char) != char):
            out[c] = JOINS
    for a, b in ((0x1100, 0x1200), (0xA960, 0xA980), (0xD7B0, 0xD800)):
        # the parts of Korean syllables
        out[a:b] |= JOINS
    return out


def points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the characters beyond ASCII start, their code points, and their sizes in bytes."""
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead]
    size = 2 + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
    end = len(data) - 1
    point = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07)).astype(np.int64)
    for k in (1, 2, 3):
        more = size > k
        point[more] = point[more] << 6 | (data[np.minimum(lead[more] + k, end)] & 0x3F)
    return lead, np.minimum(point, sys.maxunicode), size


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = kinds()[:256].copy()
    out[128:] = OTHER
    out = out[data]
    lead, point, size = points(data)
    if len(lead):
        end = len(data) - 1
        kind = kinds()[point]
        out[lead] = kind
        for k in (1, 2, 3):
            more = (size > k) & (lead + k <= end)
            out[lead[more] + k] = kind[more]
    return out


def contractions(data: np.ndarray, start: np.ndarray, segment: np.ndarray) -> None:
    """At an apostrophe that starts a pretoken, 's 't 'm 'd 're 've 'll are pretokens; start is changed in place."""
    at = np.flatnonzero(start & (data == 39))
    if not len(at):
        return
    padded, cut = np.concatenate([data, np.zeros(4, np.uint8)]), np.concatenate([segment, np.ones(4, bool)])
    one, two = padded[at + 1], padded[at + 2]
    inside = ~cut[at + 1]
    short = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = inside & ~cut[at + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    start[at[short | long] + 1] = False
    after = np.concatenate([at[short] + 2, at[long] + 3])
    start[after[after < len(start)]] = True


def spaced(data: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Starts for the vocabulary that keeps white space: a blank goes with what follows, other white space stands alone.

    segment marks the first byte of each piece of text that is split on its own.
    """
    kind = classes(data)
    lead = (data & 0xC0) != 0x80
    start = np.ones(len(data), bool)
    before, previous = kind[:-1], data[:-1]
    start[1:] = (kind[1:] != before) & ~((previous == 32) & (kind[1:] != SPACE))
    # the last character of white space before something else is a pretoken, or the start of one
    follows = np.zeros(len(data), bool)
    follows[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~segment[1:]
    for at in np.flatnonzero(follows & ~lead).tolist():
        follows[at] = False
        while not lead[at]:
            at -= 1
        follows[at] = True
    start |= follows | segment
    contractions(data, start, segment)
    return start


def unspaced(data: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and final bytes for the vocabulary that drops white space: runs of letters, single numbers, runs of the rest."""
    kind = classes(data)
    lead = (data & 0xC0) != 0x80
    start = segment.copy()
    start[1:] |= kind[1:] != kind[:-1]
    start |= lead & (kind == NUMBER)
    contractions(data, start, segment)
    start[after_space(kind, segment)] = True
    start &= kind != SPACE
    final = np.ones(len(data), bool)
    final[:-1] = start[1:] | (kind[1:] == SPACE) | segment[1:]
    final &= kind != SPACE
    return start, final


def after_space(kind: np.ndarray, segment: np.ndarray) -> np.ndarray:
    at = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    return at
