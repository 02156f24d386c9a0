"""Operator 10, line dedup by a segment-partition edit join.

Lines are linked that are at most ``threshold`` edits apart, and at most one edit for every ``per_edit``
characters of the shorter; with lines linked in turn, of each class of lines the first by (id, line
number) stays and the others go.  So of lines below ``per_edit`` characters only exact copies go: two edits make
most short lines into others, and in turn into all.  Blank lines always stay.

A line is cut into as many segments as it may have edits, and one more.  If two lines are within their
edits, one segment of the shorter occurs unchanged in the other, displaced by no more than
what the edits before and after it allow; so each line is entered under its segments
and probes, for its own length and the next shorter ones, the few substrings that can
be such a segment (the multi-match-aware selection of the published Pass-Join method).
1. Keys (length, segment number, content hash) of all distinct lines meet in sorted arrays by key
   range; only keys under which different lines meet go on.
2. Those lines' texts are fetched and dealt by key.  A key under which more than ``block`` lines meet (a start that
   very many lines have) is replaced: lines within t edits share two of t + 2 pieces, so they
   meet under pairs of pieces, which hardly any others share.  What is too large even so is split into pairs of blocks.
   Candidates must agree in length and in a 64-bit parity of their character pairs,
   where an edit flips 4 bits at most; then the banded bit-parallel edit distance decides.
   A group is searched breadth first and gives a spanning forest, not all pairs.
3. Components give the classes.

Copies of a line are one line from the start, told by 128 bits of BLAKE2b, under which no two different texts are
known or expected to be equal; what meets by 64-bit keys is compared character by character.
A line on a third of all pages is one row a task, and its instances find their class by a broadcast
of the lines that make up more than a 1,024th of all, which are 1,024 at most.

Edge cases: a null text has no lines; rows repeated in full count as one
document; the newline after a removed line goes with it; an empty table gives an
empty result.  Columns that are not asked for are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pack_texts, parts_for, ragged, release, slices, sorted_groups, unpacked
from .edit_distance import within
from .family import CONTESTED, batch_entries
from .graph import connected_components
from .suffix_dedup import ENTRY, SLICE, _rows, mix, powers

THRESHOLD, PER_EDIT, BLOCK = 2, 20, 1024
#: Lines that are more than this share of all are broadcast.
OFTEN = 1024
#: A mark: the key is one of the line's own segments.
SEGMENT = 8
#: Bits of the parity that an edit can flip.
FLIPS = 4
SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


class Lines:
    """The lines of a few texts, and hashes of any of their substrings."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        joined = "\n".join(texts) + "\n"
        self.raw = joined.encode()
        self.points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        breaks = np.flatnonzero(self.points == 10)
        self.start = np.concatenate([[0], breaks[:-1] + 1])
        self.size = breaks - self.start
        counts = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        self.row = np.repeat(np.arange(len(texts)), counts)
        self.number = ragged(np.zeros(len(texts), np.int64), counts)
        n = len(self.points)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        letters = mix(self.points.astype(np.uint64) + np.uint64(0x51ED2701)) | np.uint64(1)
        np.cumsum(letters * up[:n], out=self.sums[1:])

    def chosen(self) -> np.ndarray:
        """The lines that are not blank."""
        ink = np.concatenate([[0], np.cumsum(~np.isin(self.points, SPACES))])
        return np.flatnonzero(ink[self.start + self.size] > ink[self.start])

    def digests(self, lines: np.ndarray) -> np.ndarray:
        """16 bytes of BLAKE2b for each of some lines, as two columns."""
        ends = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        raw = self.raw
        out = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[lines].tolist(), ends[lines].tolist())]
        return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)

    def hashes(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.sums[first + size] - self.sums[first]) * self.down[first] + size.astype(np.uint64))


def segments(length: np.ndarray, i: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of segment i (from 0); the longer segments come last."""
    base, longer = np.divmod(length, threshold + 1)
    short = threshold + 1 - longer
    return i * base + np.maximum(0, i - short), base + (i >= short)


def allowed(size: np.ndarray, threshold: int, per_edit: int) -> np.ndarray:
    """How many edits a line of that length may be away."""
    return np.minimum(threshold, size // per_edit)


def keys_of(lines: Lines, chosen: np.ndarray, own: np.ndarray, threshold: int, per_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line's hash, mark) of all segments and probes of the chosen lines, whose hashes are ``own``."""
    start, size = lines.start[chosen], lines.size[chosen]
    none = np.zeros(0, np.uint64)
    keys, subs, marks = [none], [none], [none.astype(np.uint8)]
    for shorter in range(threshold + 1):
        edits = allowed(size - shorter, threshold, per_edit)
        for t in range(max(1, shorter), threshold + 1):
            some = np.flatnonzero(edits == t)
            if not len(some):
                continue
            at, length, sub = start[some], size[some] - shorter, own[some]
            for i in range(t + 1):
                offset, width = segments(length, i, t)
                for shift in range(-t, t + 1):
                    # edits before the segment, and after it, that the displacement takes
                    if abs(shift) > i or abs(shift - shorter) > t - i:
                        continue
                    content = lines.hashes(at + offset + shift, width)
                    keys.append(mix(content + (length * 16 + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    subs.append(sub)
                    marks.append(np.full(len(some), SEGMENT if not shorter and not shift else 0, np.uint8))
    return np.concatenate(keys), np.concatenate(subs), np.concatenate(marks)


def pair_keys(lines: Lines, own: np.ndarray, threshold: int, per_edit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``keys_of`` for all lines, by pairs of pieces: of t + 2 pieces two stay whole under t edits."""
    start, size = lines.start, lines.size
    none = np.zeros(0, np.uint64)
    keys, subs, marks = [none], [none], [none.astype(bool)]
    for shorter in range(threshold + 1):
        edits = allowed(size - shorter, threshold, per_edit)
        for t in range(max(1, shorter), threshold + 1):
            some = np.flatnonzero(edits == t)
            if not len(some):
                continue
            at, length, sub = start[some], size[some] - shorter, own[some]
            cut = [segments(length, i, t + 1) for i in range(t + 2)]
            content = {(i, d): lines.hashes(at + np.clip(cut[i][0] + d, 0, size[some] - cut[i][1]), cut[i][1]) for i in range(t + 2) for d in range(-t, t + 1)}
            for i, j in combinations(range(t + 2), 2):
                for d in range(-t, t + 1):
                    for e in range(-t, t + 1):
                        # edits before, between and after the two
                        if abs(d) + abs(e - d) + abs(shorter - e) > t:
                            continue
                        inside = (cut[i][0] + d >= 0) & (cut[j][0] + e + cut[j][1] <= size[some])
                        both = mix(content[i, d]) + content[j, e] * np.uint64(0xD6E8FEB86659FD93)
                        key = mix(both + (length * 256 + i * 16 + j).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        keys.append(key[inside])
                        subs.append(sub[inside])
                        marks.append(np.full(int(inside.sum()), not shorter and not d and not e))
    return np.concatenate(keys), np.concatenate(subs), np.concatenate(marks)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, 512):
        yield from slices(unpacked(batch.slice(k, 512)), "text", SLICE)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            lines = Lines(part.column("text").to_pylist())
            chosen = lines.chosen()
            own = lines.digests(chosen).view(np.int64)
            take = pa.array(lines.row[chosen])
            yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("rid").take(take), pa.array(lines.number[chosen].astype(np.int32)), pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())], names=["id", "rid", "line", "h", "g"])
    release()


def _segment_rows(threshold: int, per_edit: int, shards: int):
    """The sorted array of a task's lines, cut by key range; goes out whenever it holds enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, sub, mark = (np.concatenate(x) for x in zip(*held))
            yield from _rows(0, shards, *batch_entries(key, sub, mark)).to_batches()

        for batch in batches:
            for part in _parts(batch):
                lines = Lines(part.column("text").to_pylist())
                long = np.flatnonzero(lines.size >= per_edit)
                own, first = np.unique(lines.digests(long)[:, 0], return_index=True)
                held.append(keys_of(lines, long[first], own, threshold, per_edit))
                rows += len(held[-1][0])
                if rows >= 1 << 21:
                    yield from out()
                    held, rows = [], 0
        if held:
            yield from out()
        del held
        release()

    return run


def _pair_rows(threshold: int, per_edit: int):
    """(key, h, own): the lines of hot keys under pairs of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                key, sub, own = pair_keys(Lines(part.column("line").to_pylist()), part.column("h").to_numpy().view(np.uint64), threshold, per_edit)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sub.view(np.int64)), pa.array(own)], names=["key", "h", "own"])

    return run


def _met(table: pa.Table) -> pa.Table:
    """(key, h, n): lines that meet others under a key that is a segment of one of them, and how many meet there."""
    key, sub, mark = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("key", np.uint64), ("sub", np.uint64), ("mark", np.uint8)))
    # most keys stand alone; only the others need their lines in order
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    several = np.zeros(len(key), bool)
    several[1:] = same
    several[:-1] |= same
    keep = order[several]
    # one entry for each pair
    key, sub, mark = batch_entries(key[keep], sub[keep], mark[keep])
    keep = np.flatnonzero(mark & CONTESTED)
    key, sub, mark = key[keep], sub[keep], mark[keep]
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([first, [len(key)]]))
        segment = np.repeat(np.bitwise_or.reduceat(mark, first) & SEGMENT > 0, count)
        key, sub, count = key[segment], sub[segment], np.repeat(count, count)[segment]
    else:
        count = np.zeros(0, np.int64)
    release()
    return pa.table({"key": pa.array(key.view(np.int64)), "h": pa.array(sub.view(np.int64)), "n": pa.array(count.astype(np.int64))})


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, line) for the wanted line numbers of each text."""
    for part in (p for batch in batches for p in _parts(batch)):
        h, g, lines = [], [], []
        for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
            own = text.split("\n")
            for w in wanted:
                h.append(w["h"])
                g.append(w["g"])
                lines.append(own[w["line"]])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(lines, pa.string())], names=["h", "g", "line"])


def parity(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each line, the parities of its character pairs in 64 classes."""
    pairs = np.maximum(size - 1, 0)
    at = ragged(start, pairs)
    bit = np.uint64(1) << (mix(points[at].astype(np.uint64) << np.uint64(32) | points[at + 1]) >> np.uint64(58))
    total = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(bit)]) if len(bit) else np.zeros(1, np.uint64)
    ends = np.cumsum(pairs)
    return total[ends] ^ total[ends - pairs]


def spanning(texts: list[str], side: np.ndarray, threshold: int, per_edit: int) -> list[tuple[int, int]]:
    """Links between distinct lines that connect what is connected; side 0 and 1 meet each other only, side 2 itself."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    sign = parity(points, start, size)
    links, rest = [], np.arange(len(texts))
    frontier: list[int] = []
    while len(rest) or frontier:
        if not frontier:
            frontier.append(int(rest[0]))
            rest = rest[1:]
        one = frontier.pop()
        near = rest[(np.bitwise_count(sign[rest] ^ sign[one]) <= FLIPS * threshold) & (np.abs(size[rest] - size[one]) <= threshold) & ((side[rest] != side[one]) | (side[rest] == 2))]
        if not len(near):
            continue
        near = near[within(points, np.full(len(near), start[one]), np.full(len(near), size[one]), start[near], size[near], threshold, allowed(np.minimum(size[near], size[one]), threshold, per_edit))]
        links += [(one, int(x)) for x in near]
        frontier += near.tolist()
        rest = rest[~np.isin(rest, near)]
    return links


def _verify(threshold: int, per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, seen = [], [], set()

        def small(groups: list[tuple[list[int], list[str]]]) -> None:
            """All pairs of many small groups at once."""
            texts = [t for _, lines in groups for t in lines]
            ids = np.array([h for hashes, _ in groups for h in hashes], np.int64)
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            start = np.cumsum(size) - size
            sign = parity(points, start, size)
            group = np.repeat(np.arange(len(groups)), [len(h) for h, _ in groups])
            a, b = [], []
            for d in range(1, 9):
                x = np.flatnonzero(group[d:] == group[:-d])
                a.append(x)
                b.append(x + d)
            a, b = np.concatenate(a), np.concatenate(b)
            ok = np.flatnonzero((np.bitwise_count(sign[a] ^ sign[b]) <= FLIPS * threshold) & (np.abs(size[a] - size[b]) <= threshold))
            a, b = a[ok], b[ok]
            pairs, first = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1, return_index=True)
            new = np.array([k for k, p in zip(first.tolist(), pairs.T.tolist()) if tuple(p) not in seen], np.int64)
            if len(seen) < 1 << 18:
                seen.update(map(tuple, pairs.T.tolist()))
            if len(new):
                a, b = a[new], b[new]
                hit = within(points, start[a], size[a], start[b], size[b], threshold, allowed(np.minimum(size[a], size[b]), threshold, per_edit))
                us.extend(ids[a[hit]].tolist())
                vs.extend(ids[b[hit]].tolist())

        waiting: list[tuple[list[int], list[str]]] = []
        waited = 0
        for group in sorted_groups(batches, "pair"):
            hashes, lines = group.column("h").to_pylist(), group.column("line").to_pylist()
            side = group.column("side").to_numpy()
            if len(hashes) <= 9 and (side == 2).all():
                waiting.append((hashes, lines))
                waited += sum(map(len, lines))
            else:
                for i, j in spanning(lines, side, threshold, per_edit):
                    us.append(hashes[i])
                    vs.append(hashes[j])
            if waited > 1 << 20:
                small(waiting)
                waiting, waited = [], 0
        if waiting:
            small(waiting)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        release()

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in _parts(b)):
        kept, n, gone = [], [], []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            lines = text.split("\n")
            n.append(len(lines))
            gone.append(len(removed or ()))
            if removed:
                out = set(removed)
                text = "\n".join(x for k, x in enumerate(lines) if k not in out)
            kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rest"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "rest", "n_lines", "n_removed", "text"])


def line_links(rows: DataFrame, own: DataFrame, threshold: int, per_edit: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) that span the classes of the distinct lines, by their h; and the rows of ``own`` that the links are about.

    ``own`` has a row (h, g, first, n) for every distinct line.
    """
    n = parts_for(rows)
    entries = rows.select("text").mapInArrow(_segment_rows(threshold, per_edit, n), ENTRY)
    met = materialise(entries.repartition(n, "shard").groupBy("shard").applyInArrow(_met, "key long, h long, n long"), "met")
    # a line's text comes from its first document
    own = materialise(own.join(met.select("h").distinct(), "h"), "met-lines")
    wanted = own.select("first.id", "first.rid", F.struct(F.col("first.line").alias("line"), "h", "g").alias("w"))
    wanted = wanted.groupBy("id", "rid").agg(F.collect_list("w").alias("wanted")).withColumnsRenamed({"id": "wid", "rid": "wrid"}).hint("shuffle_hash")
    fetched = rows.select("id", "rid", "text").join(wanted, (F.col("rid") == F.col("wrid")) & F.col("id").eqNullSafe(F.col("wid"))).select("text", "wanted").mapInArrow(_fetch, "h long, g long, line string")
    # rows repeated in full give a line twice; of lines that share h, if there ever are such, one takes part
    texts = materialise(fetched.groupBy("h").agg(F.min(F.struct("g", "line")).alias("x")).select("h", "x.g", "x.line"), "lines")
    plain = texts.select("h", "line")
    cold = met.filter(F.col("n") <= block).select("key", "h", F.lit(1).alias("blocks"))
    hot = plain.join(met.filter(F.col("n") > block).select("h").distinct(), "h", "left_semi")
    paired = hot.mapInArrow(_pair_rows(threshold, per_edit), "key long, h long, own boolean")
    paired = paired.groupBy("key", "h").agg(F.bool_or("own").alias("own"))
    sizes = paired.groupBy("key").agg(F.count("*").alias("c"), F.bool_or("own").alias("any")).filter("any AND c > 1")
    fine = paired.join(sizes, "key").select("key", "h", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    dealt = cold.unionByName(fine).join(plain, "h")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("h", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(".", "key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(pair.alias("pair"), side.cast("int").alias("side"), "h", "line")
    # a fixed number: what counts is the comparing, not the bytes
    links = dealt.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(_verify(threshold, per_edit), "u long, v long").distinct()
    return links, own.join(texts.select("h", "g"), ["h", "g"])


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, per_edit: int = PER_EDIT, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_lines, n_removed, text, and the columns named to be carried): every text without the lines that stand earlier."""
    if per_edit < 3:
        raise ValueError("per_edit must be 3 or more, so that each segment has characters")
    n = parts_for(df)
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry))) if carry else F.lit(0)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    # the texts are dealt once; both joins below find them where they are
    rows = pack_texts(rows.withColumn("rid", F.xxhash64("id", "text"))).repartition(n, "rid").persist(StorageLevel.DISK_ONLY)
    kind = df.schema[id_col].dataType.simpleString()
    lines = materialise(rows.select("id", "text", "rid").mapInArrow(_line_rows, f"id {kind}, rid long, line int, h long, g long"), "line-rows")
    own = materialise(lines.groupBy("h", "g").agg(F.min(F.struct("id", "rid", "line")).alias("first"), F.count("*").alias("n")), "distinct-lines")
    links, linked = line_links(rows, own, threshold, per_edit, block)
    components = connected_components(links).withColumnRenamed("node", "h")
    linked = materialise(linked.join(components, "h"), "linked")
    # a line that is linked with none is a class of its own, and of those only the ones that come again matter
    again = own.filter("n > 1").join(linked.select("h", "g"), ["h", "g"], "left_anti")
    own = linked.select("h", "g", "first", "n", "root", F.lit(None).cast("long").alias("alone"))
    own = own.unionByName(again.select("h", "g", "first", "n", F.col("h").alias("root"), F.col("g").alias("alone")))
    # only classes with several lines go on
    several = own.groupBy("root", "alone").agg(F.min("first").alias("least"), F.sum("n").alias("total")).filter("total > 1")
    several = several.select(F.col("root").alias("r"), F.col("alone").alias("a"), "least")
    classes = own.join(several, (F.col("root") == F.col("r")) & F.col("alone").eqNullSafe(F.col("a"))).select("h", "g", "n", "least")
    classes = materialise(classes, "classes")
    # lines that make up a large share of all are few
    often = classes.filter(F.col("n") > F.lit(lines.count() // OFTEN)).drop("n")
    seldom = classes.join(F.broadcast(often.select("h", "g")), ["h", "g"], "left_anti").drop("n")
    common = lines.join(F.broadcast(often), ["h", "g"])
    others = lines.join(F.broadcast(often.select("h", "g")), ["h", "g"], "left_anti").join(seldom, ["h", "g"])
    removed = common.unionByName(others).filter(~F.struct("id", "rid", "line").eqNullSafe(F.col("least")))
    removed = removed.groupBy(F.col("id").alias("wid"), F.col("rid").alias("wrid")).agg(F.collect_set("line").alias("removed"))
    out = rows.join(removed.hint("shuffle_hash"), (F.col("rid") == F.col("wrid")) & F.col("id").eqNullSafe(F.col("wid")), "left").select("id", "rest", "text", "removed")
    out = out.mapInArrow(_drop, f"id {kind}, rest {rows.schema['rest'].dataType.simpleString()}, n_lines long, n_removed long, text string")
    return out.select(F.col("id").alias(id_col), "n_lines", "n_removed", F.col("text").alias(text_col), *(F.col(f"rest.c{k}").alias(c) for k, c in enumerate(carry)))
