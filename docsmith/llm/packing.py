"""Operator 9, best-fit packing with Martello-Toth dominance reduction.

Documents become token ids, longer ones are cut at the capacity, and the pieces
are packed into as few sequences as possible.  A piece matters by its length
alone, so an instance is a histogram of at most ``capacity`` counts whatever the
number of documents: the driver solves that, with whole ranges of equal pieces
placed at once, and gets a list of placements (length, ranks from..to ->
sequences from.., offset) whose size is bounded by the capacity, not by the data.
Each piece then looks its placement up by its rank among the pieces of its length.

Reduction: a document set dominates if any other set with document j could be
exchanged for it.  {j, k} does when k fills j's sequence exactly, or when at most
one other document fits beside j and k is the largest that does; {j} does when
nothing fits.  Such sets are fixed for good, as many as there are, until none is
left; what remains is packed by best-fit decreasing.

Edge cases: a null text counts as empty and has the end token alone; documents of
equal length are told apart by their rank, any order being as good; repeated ids
are packed as separate documents; an empty table gives an empty result.  Columns
other than id and text are not carried over.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_texts, materialise, ragged, release, slices
from .pretokens import JOINS, UNKNOWN, oddities, points, unspaced
from .token_counts import machine

CAPACITY = 2048
END = 0


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def composed():
    """The library's own composition of characters, whose tables are of another age than Python's."""
    from tokenizers.normalizers import NFC

    return NFC()


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and the offsets between texts."""
    transducer, special = machine(path)
    data, at = flat_texts(column)
    odd: dict[int, np.ndarray] = {}
    if len(data) and data.max() >= 128 or any(s in data.tobytes() for s in special):
        raw, texts = data.tobytes(), []
        lead, point, _ = points(data)
        odds = oddities()[point]
        unknown, joins, wide = (set((np.searchsorted(at, lead[x], "right") - 1).tolist()) for x in (odds & UNKNOWN > 0, odds & JOINS > 0, slice(None)))
        for row in range(len(at) - 1):
            text = raw[at[row] : at[row + 1]]
            if row in unknown or any(s in text for s in special):
                # special tokens are found before the text is normalised, and only the library's tables may know some
                # characters: it sees to those few texts
                odd[row] = np.array(library(path).encode(text.decode(), add_special_tokens=False).ids, np.int64)
                text = b""
            elif row in wide:
                shown = text.decode()
                if row in joins:
                    shown = composed().normalize_str(shown)
                text = shown.replace("Σ", "σ").lower().encode()
            texts.append(text)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    segment = np.zeros(len(data) + 1, bool)
    segment[at] = True
    segment = segment[:-1]
    start, final = unspaced(data, segment)
    # white space is dropped: the machine sees pretokens only
    start_at, final_at = np.flatnonzero(start), np.flatnonzero(final)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start_at] += 1
    inside[final_at + 1] -= 1
    keep = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    moved = np.concatenate([[0], np.cumsum(keep)])
    symbols = data[keep].astype(np.uint16)
    symbols[final[keep]] += 256
    first, end = moved[start_at], moved[final_at]
    last, _ = transducer.run(symbols, start[keep])
    places, ids = transducer.trace(last, first, end)
    counts = np.diff(np.searchsorted(places, moved[at]))
    ids = ids.astype(np.int64)
    if odd:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for row, own in odd.items():
            parts[row], counts[row] = own, len(own)
        ids = np.concatenate(parts)
    return ids, np.concatenate([[0], np.cumsum(counts)])


def cut(column: pa.Array, path: str, capacity: int, end: int = END) -> dict[str, np.ndarray]:
    """The pieces of each text: row, piece, start, length, ids and their CRC-32."""
    ids, at = token_ids(column, path)
    counts = np.diff(at)
    whole = counts + 1
    flat = np.full(int(whole.sum()), end, np.uint32)
    first = np.concatenate([[0], np.cumsum(whole)])[:-1]
    flat[ragged(first, counts)] = ids
    pieces = -(-whole // capacity)
    row = np.repeat(np.arange(len(whole)), pieces)
    piece = ragged(np.zeros(len(pieces), np.int64), pieces)
    start = piece * capacity
    length = np.minimum(capacity, whole[row] - start)
    raw, begin = memoryview(flat.astype("<u4").tobytes()), first[row] + start
    crc = np.fromiter((zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())), np.int64, len(row))
    return {"row": row, "piece": piece, "start": start, "length": length, "crc": crc, "begin": begin, "flat": flat}


def pieces_of(df: DataFrame, path: str, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """Pieces with the task that made them and their rank among that task's pieces of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "__text"):
                x = cut(part.column("__text"), path, capacity)
                length = x["length"]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                begin = np.searchsorted(ordered, ordered, "left")
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - begin + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [part.column("__id").take(pa.array(x["row"])), pa.array(x["piece"].astype(np.int32)), pa.array(x["start"]), pa.array(length), pa.array(x["crc"]), pa.array(np.full(len(length), task, np.int32)), pa.array(rank)]
                names = ["__id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    offsets = np.concatenate([x["begin"], [len(x["flat"])]]) if len(length) else np.zeros(1, np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x["flat"].astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids)


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Placements (length, first rank, how many, first sequence, offset) for a histogram of lengths, and the sequences used."""
    left = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    placed: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        placed.append((length, int(used[length]), n, first, offset))
        used[length] += n
        left[length] -= n

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while left[j]:
                have = np.flatnonzero(left[: capacity - j + 1])
                have = have[(have != j) | (left[j] > 1)]
                if not len(have):
                    n = int(left[j])
                    put(j, n, bins, 0)
                    bins, changed = bins + n, True
                    continue
                k, room = int(have[-1]), capacity - j
                two = [int(have[0])] * 2 if left[have[0]] - (have[0] == j) > 1 else have[:2].tolist()
                if k != room and (len(two) == 2 and sum(two) <= room):
                    break
                n = int(left[j] // 2 if k == j else min(left[j], left[k]))
                if not n:
                    break
                put(j, n, bins, 0)
                put(k, n, bins, j)
                bins, changed = bins + n, True
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in range(capacity, 0, -1):
        while n := int(left[length]):
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, size = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                take = min(n, size)
                put(length, take, first, capacity - room)
                keep(room - length, first, take)
                keep(room, first + take, size - take)
                continue
            each = capacity // length
            full, rest = divmod(n, each)
            for slot in range(each if full else 0):
                put(length, full, bins, slot * length)
            keep(capacity - each * length, bins, full)
            bins += full
            for slot in range(rest):
                put(length, 1, bins, slot * length)
            keep(capacity - rest * length, bins, 1 if rest else 0)
            bins += bool(rest)
    table = np.array(placed, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], bins


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one for each piece."""
    pieces = materialise(pieces_of(df, path, capacity, id_col, text_col, with_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most one row for each length up to the capacity
        counts[row["length"]] = row["count"]
    table, _ = solve(counts, capacity)
    # ranks restart with each length: one ascending key for both
    step = int(counts.max(initial=0)) + 1
    keys = table[:, 0] * step + table[:, 1]
    firsts, offsets, lows = table[:, 3], table[:, 4], table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * step + rank, "right") - 1
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(firsts[at] + rank - lows[at]), pa.array(offsets[at])], names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(by_task, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["__id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*columns, "rank")
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("__id", id_col)
