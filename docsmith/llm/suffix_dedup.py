"""Operator 2, suffix-array dedup with a logarithmic index family.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else in
the table too.  An index over every suffix of a corpus would be many times its
size, so suffixes are sampled by content: the windows (strings of that length) of a text
are dealt to runs that share their least hash of a gram of ``GRAM`` bytes, or half the length
if that is less.  Equal windows have equal least grams, so only runs of one gram can hold equal windows.

1. Each batch of documents gives the sorted array of its runs: (least gram, hash of all
   bytes of the run).  Shards by ranges of the order keep a logarithmic
   family (family.py): batches are merge-scanned against the levels, equal levels merge.
   A run whose bytes occur elsewhere is repeated as a whole.  A run whose gram
   occurs elsewhere in other bytes, or that may repeat within itself, is contested.
2. Of every distinct contested run, one copy gives the sorted array of all its windows,
   the suffixes cut at ``length``; a second family finds those that occur twice.
3. Each batch removes what its repeated runs and repeated windows cover.

Suffixes are ordered by digests (the least gram's hash and 64 bits of BLAKE2b for a run, 96 bits of it for a
window), under which equal strings of the length are neighbours, as a merge scan needs.  The cheap rolling hash only finds grams; what is
called equal is told by the cryptographic one, with which structured strings do not collide and chance would need some 10 ** 14 contested windows.  What moves between batches and shards are sorted arrays
with each value once per batch, so a string that a third of all documents
share is at most one entry a batch.  The texts are shuffled once.

``remove_repeats`` takes a whole table and keeps nothing; ``SuffixIndex`` is the same family kept in a folder, to which later
documents are added.

Edge cases: a null or short text keeps all its bytes; copies of a long text are
removed all, the first included; a text that repeats within itself counts as any other;
repeated ids are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, flat_texts, materialise, pack_texts, parts_for, ragged, release, remove, slices, unpacked
from .family import CONTESTED, FIRST, GIVEN, REPEATED, Family, Level, batch_entries, pair_index

LENGTH, GRAM = 200, 96
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE + (1 << 17))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p, k = np.ones(n, np.uint64), 1
            while k < n:
                m = min(k, n - k)
                p[k : k + m] = p[:m] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
            _powers[name] = p
    return _powers["up"], _powers["down"]


LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Runs:
    """The runs of windows of a few texts that lie one after the other."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int = LENGTH):
        n, self.length, self.raw = len(data), length, data.tobytes()
        gram = max(1, min(GRAM, length // 2))
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTERS[data] * up[:n], out=self.sums[1:])
        none = np.zeros(0, np.int64)
        self.first, self.size, self.key, self.inward = none, none, none.astype(np.uint64), none.astype(bool)
        long = np.flatnonzero(np.diff(at) >= length)
        if not len(long):
            return
        grams = mix((self.sums[gram:] - self.sums[:-gram]) * self.down[: n - gram + 1])
        least = self._least(grams, length - gram + 1)
        place = np.zeros(n + 1, np.int8)
        place[at[long]] += 1
        place[at[long + 1] - length + 1] -= 1
        window = np.flatnonzero(np.cumsum(place, dtype=np.int8)[: len(least)])
        value = least[window]
        starts = np.ones(len(window), bool)
        starts[1:] = (value[1:] != value[:-1]) | (window[1:] != window[:-1] + 1)
        head = np.flatnonzero(starts)
        # least hashes are small numbers; shards are ranges of evenly spread ones
        self.first, self.key = window[head], mix(value[head])
        self.size = np.diff(np.concatenate([head, [len(window)]]))
        # the least gram at the start of a window that is not the run's last: it comes again later in the run
        again = grams[window] == value
        again[np.concatenate([head[1:], [len(window)]]) - 1] = False
        self.inward = np.logical_or.reduceat(again, head)

    @staticmethod
    def _least(grams: np.ndarray, width: int) -> np.ndarray:
        out, have, now, m = None, 0, grams, 1
        while True:
            if width & 1:
                if out is None:
                    out, have = now, m
                else:
                    k = len(grams) - have - m + 1
                    out, have = np.minimum(out[:k], now[have : have + k]), have + m
            width >>= 1
            if not width:
                return out
            k = len(grams) - 2 * m + 1
            now, m = np.minimum(now[:k], now[m : m + k]), 2 * m

    def subs(self, runs: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The digests of all bytes of some runs."""
        first, size = self.first[runs], self.size[runs]
        return digests(self.raw, first, first + size + self.length - 1, 2).copy().view(np.uint64).ravel()

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of all windows of some runs, and their digests in two parts."""
        at = ragged(self.first[runs], self.size[runs])
        found = digests(self.raw, at, at + self.length, 3)
        return at, found[:, :2].copy().view(np.uint64).ravel(), found[:, 2].astype(np.uint64)


def digests(raw: bytes, start: np.ndarray, end: np.ndarray, words: int) -> np.ndarray:
    """BLAKE2b of the stretches raw[start:end], in words of 32 bits: a polynomial can take structured strings for one another, this cannot be made to."""
    size = 4 * words
    out = [blake2b(raw[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist())]
    return np.frombuffer(b"".join(out), np.uint32).reshape(-1, words)


def _parts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in table.combine_chunks().to_batches():
        # the compressed texts of a batch fit a task; they are expanded a few at a time
        for k in range(0, whole.num_rows, 512):
            for part in slices(unpacked(whole.slice(k, 512)), "text", SLICE):
                data, at = flat_texts(part.column("text"))
                yield part, data, at


ENTRY = "shard int, batch int, key binary, sub binary, mark binary"
FLAG = "batch int, kind int, key binary, sub binary, mark binary"


def subs_of(row: dict) -> np.ndarray:
    """The second parts of a row's entries, which are half as wide as the keys where that is enough."""
    return np.frombuffer(row["sub"], np.uint64 if len(row["sub"]) == len(row["key"]) else np.uint32).astype(np.uint64)


def _rows(batch: int, shards: int, key: np.ndarray, sub: np.ndarray, mark: np.ndarray, narrow: bool = False) -> pa.Table:
    """A row for each shard that has entries; shards are ranges of the keys.  With ``narrow``, subs of 32 bits are written as such."""
    sub = sub.astype(np.uint32) if narrow else sub
    own = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    used, first = np.unique(own, return_index=True)
    cuts = [*first.tolist(), len(key)]
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"shard": pa.array(used, pa.int32()), "batch": pa.array([batch] * len(used), pa.int32()), "key": pa.array(cut(key), pa.binary()), "sub": pa.array(cut(sub), pa.binary()), "mark": pa.array(cut(mark), pa.binary())})


def _arrays(table: pa.Table, kind: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of several rows, by key and sub."""
    rows = [r for r in table.select(["key", "sub", "mark"] + ["kind"] * (kind is not None)).to_pylist() if kind is None or r["kind"] == kind]
    key = np.frombuffer(b"".join(r["key"] for r in rows), np.uint64)
    sub = np.concatenate([np.zeros(0, np.uint64), *(subs_of(r) for r in rows)])
    mark = np.frombuffer(b"".join(r["mark"] for r in rows), np.uint8)
    order = np.lexsort((sub, key))
    return key[order], sub[order], mark[order]


def _run_entries(length: int, shards: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = []
        for _, data, at in _parts(table):
            runs = Runs(data, at, length)
            found.append({"key": runs.key, "sub": runs.subs(), "inward": runs.inward})
        join = lambda name: np.concatenate([r[name] for r in found])
        release()
        return _rows(key[0].as_py(), shards, *batch_entries(join("key"), join("sub"), join("inward") * np.uint8(CONTESTED)))

    return run


def _add_rows(family: Family, table: pa.Table) -> None:
    for r in sorted(table.to_pylist(), key=lambda r: r["batch"]):
        family.add(np.frombuffer(r["key"], np.uint64), subs_of(r), np.frombuffer(r["mark"], np.uint8), r["batch"])


def _flags(family: Family, kind: int, wanted: int) -> pa.Table:
    rows = [(owner, kind, key.tobytes(), sub.tobytes(), mark.tobytes()) for owner, key, sub, mark in family.marked(wanted)]
    columns = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["batch", "kind", "key", "sub", "mark"])


def _index(kind: int, wanted: int):
    """The family of a shard; gives each batch its entries that carry a wanted mark."""

    def run(table: pa.Table) -> pa.Table:
        release()
        family = Family()
        _add_rows(family, table)
        return _flags(family, kind, wanted)

    return run


LEVEL = "level int, shard int, batch int, kind int, key binary, sub binary, mark binary, owner binary"


def _grow(kind: int, wanted: int):
    """The family of a shard with its kept levels taken up and new batches added; gives the levels, and as level -1 what carries a wanted mark."""

    def run(key: tuple, kept: pa.Table, new: pa.Table) -> pa.Table:
        release()
        levels = sorted(kept.to_pylist(), key=lambda r: r["level"])
        family = Family([Level(*(np.frombuffer(r[c], t).copy() for c, t in (("key", np.uint64), ("sub", np.uint64), ("owner", np.int32), ("mark", np.uint8)))) for r in levels])
        _add_rows(family, new)
        flags = _flags(family, kind, wanted)
        out = [{"level": -1, "shard": key[0].as_py(), "owner": None} | r for r in flags.to_pylist()]
        for k, level in enumerate(family.levels):
            if kind == 1:
                level.mark[level.mark & (CONTESTED | FIRST) == CONTESTED | FIRST] |= GIVEN
            out.append({"level": k, "shard": key[0].as_py(), "batch": None, "kind": kind, "key": level.key.tobytes(), "sub": level.sub.tobytes(), "mark": level.mark.tobytes(), "owner": level.owner.tobytes()})
        kinds = {"key": pa.binary(), "sub": pa.binary(), "mark": pa.binary(), "owner": pa.binary()}
        names = ["level", "shard", "batch", "kind", "key", "sub", "mark", "owner"]
        return pa.Table.from_pylist(out, pa.schema([(n, kinds.get(n, pa.int32())) for n in names]))

    return run


def _marks(runs: Runs, flags: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The marks and subs of the runs; both are zero where no flag has the key, which saves most digests."""
    key, sub, mark = flags
    marks, subs = np.zeros(len(runs.key), np.uint8), np.zeros(len(runs.key), np.uint64)
    near = np.flatnonzero(np.searchsorted(key, runs.key, "right") > np.searchsorted(key, runs.key, "left"))
    if len(near):
        subs[near] = runs.subs(near)
        _, _, place = pair_index(key, sub, runs.key[near], subs[near])
        marks[near] = np.where(place >= 0, mark[place], 0)
    return marks, subs


def _window_entries(length: int, shards: int):
    def run(key: tuple, texts: pa.Table, flags: pa.Table) -> pa.Table:
        own, seen = _arrays(flags), set()
        keys, subs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        wanted, asked = CONTESTED | FIRST, CONTESTED | FIRST | GIVEN
        own = tuple(x[own[2] & asked == wanted] for x in own)
        if len(own[0]):
            for _, data, at in _parts(texts):
                runs = Runs(data, at, length)
                marks, run_subs = _marks(runs, own)
                chosen = []
                for k in np.flatnonzero(marks).tolist():
                    # of copies within the batch, one
                    pair = (int(runs.key[k]), int(run_subs[k]))
                    if pair not in seen:
                        seen.add(pair)
                        chosen.append(k)
                _, key_, sub_ = runs.windows(np.array(chosen, np.int64))
                keys.append(key_)
                subs.append(sub_)
        keys, subs = np.concatenate(keys), np.concatenate(subs)
        release()
        return _rows(key[0].as_py(), shards, *batch_entries(keys, subs, np.zeros(len(keys), np.uint8)), narrow=True)

    return run


def _remove(length: int, whole_characters: bool):
    def run(key: tuple, texts: pa.Table, flags: pa.Table) -> pa.Table:
        own, (windows, parts, _) = _arrays(flags, 1), _arrays(flags, 2)
        out = []
        for part, data, at in _parts(texts):
            n = len(data)
            runs = Runs(data, at, length)
            mark, _ = _marks(runs, own)
            whole = np.flatnonzero(mark & REPEATED)
            place, key_, sub_ = runs.windows(np.flatnonzero(mark & (REPEATED | CONTESTED) == CONTESTED))
            place = place[pair_index(windows, parts, key_, sub_)[2] >= 0] if len(windows) else place[:0]
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, np.concatenate([runs.first[whole], place]), 1)
            np.add.at(depth, np.concatenate([runs.first[whole] + runs.size[whole] - 1 + length, place + length]), -1)
            gone = np.cumsum(depth[:-1]) > 0
            if whole_characters and gone.any():
                lead = (data & 0xC0) != 0x80
                gone = np.logical_or.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]
            edge = np.zeros(n + 1, bool)
            edge[at] = True
            opens = gone.copy()
            opens[1:] &= ~gone[:-1] | edge[1:n]
            closes = gone.copy()
            closes[:-1] &= ~gone[1:] | edge[1:n]
            start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            row = np.searchsorted(at, start, "right") - 1
            # rows without bytes share their offset with the next one
            spans = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at) - 1))]).astype(np.int32)
            kept = data[~gone]
            offsets = at - np.concatenate([[0], np.cumsum(gone)])[at]
            array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())])
            lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x - at[row])) for x in (start, end)]
            columns = [part.column("id"), part.column("rest"), pa.array(np.diff(at)), *lists, array.cast(pa.binary())]
            out.append(pa.RecordBatch.from_arrays(columns, names=["id", "rest", "n_bytes", "starts", "ends", "kept"]))
        schema = pa.schema([("id", texts.schema.field("id").type), ("rest", texts.schema.field("rest").type), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])
        release()
        return pa.Table.from_batches(out, schema)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """(id, n_bytes, starts, ends, kept, and the columns named to be carried): the removed spans of each text and the bytes that stay.

    Batches and shards are as many as ``spark.sql.shuffle.partitions``, or more where a batch would have
    more than its share of the files' bytes, so a batch of texts, and the digests of a batch or shard, fit a task.  With
    ``whole_characters``, a character that loses a byte goes whole, so what stays is text.
    """
    n = parts_for(df)
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry))) if carry else F.lit(0)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    # with a table that is read again for each of the three passes, one shuffle of texts does
    rows = pack_texts(rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))).repartition(n, "batch").persist(StorageLevel.DISK_ONLY)
    texts = rows.select("batch", "text")
    entries = texts.groupBy("batch").applyInArrow(_run_entries(length, n), ENTRY)
    flags = materialise(entries.repartition(n, "shard").groupBy("shard").applyInArrow(_index(1, REPEATED | CONTESTED), FLAG), "runs")
    windows = texts.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(_window_entries(length, n), ENTRY)
    flags = flags.unionByName(materialise(windows.repartition(n, "shard").groupBy("shard").applyInArrow(_index(2, REPEATED), FLAG), "windows"))
    out = _removed(rows, flags, length, whole_characters)
    return out.select(F.col("id").alias(id_col), "n_bytes", "starts", "ends", "kept", *(F.col(f"rest.c{k}").alias(c) for k, c in enumerate(carry)))


def _removed(rows: DataFrame, flags: DataFrame, length: int, whole_characters: bool) -> DataFrame:
    schema = f"id {rows.schema['id'].dataType.simpleString()}, rest {rows.schema['rest'].dataType.simpleString()}, n_bytes long, starts array<long>, ends array<long>, kept binary"
    return rows.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(_remove(length, whole_characters), schema)


class SuffixIndex:
    """The family kept in a folder, so that documents can be added by one call after another, of one session or several.

    A call of ``add`` deals its documents to new batches, takes up the stored levels of each shard, merge-scans the
    batches against them, merges levels of a size, and writes the levels again, since a match marks both sides.  Windows are made only
    of runs that have become contested by the call, from the stored texts of the batches that hold them.  Each call writes
    a folder of its own and counts once its last table is whole; a call that failed is overwritten by the next, and calls that run
    at the same time are not provided for.  ``removals`` gives what ``remove_repeats`` would of all documents at once, or
    only of those that the last call added: a document added earlier can lose bytes by one added later.

    ``shards`` and ``length`` are fixed by the first call; shards, and batches of one call, are as in ``remove_repeats``
    unless given, so name a number that fits the whole corpus to come.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, shards: int | None = None):
        self.spark, self.path, self.length, self.shards = spark, path.rstrip("/"), length, shards
        self.calls = 0
        while exists(spark, f"{self._at(self.calls + 1)}/state/_SUCCESS"):
            self.calls += 1
        self.batches = 0
        if self.calls:
            self.length, self.shards, self.batches = spark.read.parquet(f"{self._at(self.calls)}/state").first()

    def _at(self, call: int) -> str:
        return f"{self.path}/call-{call:06d}"

    def _levels(self, name: str) -> DataFrame:
        if self.calls:
            return self.spark.read.schema(LEVEL).parquet(f"{self._at(self.calls)}/{name}")
        return self.spark.createDataFrame([], LEVEL)

    def _texts(self, call: int) -> DataFrame:
        return self.spark.read.parquet(*(f"{self._at(k)}/texts" for k in range(1, call + 1)))

    def add(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents; ids may come again, as rows of their own."""
        n, call = parts_for(df), self.calls + 1
        shards, here = self.shards or n, self._at(call)
        rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.lit(0).alias("rest"))
        batch = F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int") + F.lit(self.batches)
        pack_texts(rows.withColumn("batch", batch)).repartition(n, "batch").write.mode("overwrite").parquet(f"{here}/texts")
        new = self.spark.read.parquet(f"{here}/texts").select("batch", "text")
        entries = new.groupBy("batch").applyInArrow(_run_entries(self.length, shards), ENTRY)
        self._scan("runs", entries, _grow(1, REPEATED | CONTESTED), here)
        flags = self.spark.read.schema(LEVEL).parquet(f"{here}/runs").filter("level = -1").select("batch", "kind", "key", "sub", "mark")
        texts = self._texts(call).select("batch", "text")
        windows = texts.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(_window_entries(self.length, shards), ENTRY)
        self._scan("windows", windows, _grow(2, REPEATED), here)
        state = self.spark.createDataFrame([(self.length, shards, self.batches + n)], "length int, shards int, batches int")
        state.write.mode("overwrite").parquet(f"{here}/state")
        before = self.calls
        self.calls, self.shards, self.batches = call, shards, self.batches + n
        for name in ("runs", "windows") if before else ():
            remove(self.spark, f"{self._at(before)}/{name}")

    def _scan(self, name: str, entries: DataFrame, grow, here: str) -> None:
        grown = self._levels(name).filter("level >= 0").groupBy("shard").cogroup(entries.groupBy("shard")).applyInArrow(grow, LEVEL)
        grown.write.mode("overwrite").parquet(f"{here}/{name}")

    def removals(self, last_only: bool = False, whole_characters: bool = False) -> DataFrame:
        """(id, n_bytes, starts, ends, kept) of all documents, or of those of the last call."""
        rows = self.spark.read.parquet(f"{self._at(self.calls)}/texts") if last_only else self._texts(self.calls)
        flags = self._levels("runs").unionByName(self._levels("windows")).filter("level = -1").select("batch", "kind", "key", "sub", "mark")
        if last_only:
            flags = flags.join(rows.select("batch").distinct(), "batch", "left_semi")
        return _removed(rows, flags, self.length, whole_characters).drop("rest")
