"""Operator 4, SimHash near-duplicates through segment popcounts.

A fingerprint is embedded as the popcounts of its 32 two-bit segments.  The
Manhattan distance of two embeddings is a lower bound of the Hamming distance, and in
unary (0, 1, 11 for a count of 0, 1, 2) it is itself a count of differing bits.
The join is a range join on a grid: the segments lie in two blocks, and fingerprints at distance 4 or less
are at Manhattan distance 2 or less in one of them.  There each takes its own cell, which
is its counts in that block, and the cells one step away (a count one higher or lower); any two at distance 2
have a cell between them.  Some 24 bits tell a block's cells apart, at a cost of about 50 rows a fingerprint.
Within a cell the Manhattan bound over both blocks is tested first, then the exact distance.

Copies are one row: the join is over distinct fingerprints.  A cell is searched
breadth first, comparing with what is not reached yet, and gives a spanning
forest of its links rather than all pairs; so a dense group costs about its size.
There are at most 679,121 fingerprints within 4 bits of one, which bounds what a
group of near copies can bring into a cell, however many documents it has.

``similar_documents`` is for a similarity that 4 bits are too few for: of 128 bits over five-word shingles, near copies with
four fifths of their shingles in common differ in about one of seven.  The method is the same with other numbers: 64 two-bit
segments, a block for every three bits of the radius (eight at 23 bits, so that any pair within it is at distance 2 or less in one),
a fingerprint's own cell and those one step away in each block (about 104 rows), the Manhattan bound over all segments, the exact
distance.  No pair within the radius is lost.

Edge cases: a null or wordless text has fingerprint zero, which links as any other;
fewer words than a shingle make one shingle; repeated ids are separate rows; an empty
table gives an empty result.  Columns other than id and text are not carried over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_texts, materialise, release, slices
from .graph import connected_components

BITS, RADIUS, BLOCKS = 64, 4, 2
EVEN = np.uint64(0x5555555555555555)
#: For similar documents: bits of the fingerprint.
WIDE = 128


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The majority of the bits of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(__id, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, at = flat_texts(part.column("__text"))
                raw = data.tobytes()
                found = np.array([fingerprint(raw[a:b], width, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(found.view(np.int64))], names=["__id", "fp"])
        release()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, fp long")


def embed(x: np.ndarray) -> np.ndarray:
    """The popcounts of the two-bit segments, in unary."""
    high = (x >> np.uint64(1)) & EVEN
    low = x & EVEN
    return (low | high) | ((low & high) << np.uint64(1))


def blocks() -> list[np.uint64]:
    """The masks of the blocks: every other segment."""
    masks = [np.uint64(0)] * BLOCKS
    for segment in range(BITS // 2):
        masks[segment % BLOCKS] |= np.uint64(3 << 2 * segment)
    return masks


def steps(unary: np.ndarray, mask: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cells): the own cell of every row in a block, and those a step away of the rows that have them."""
    cell = unary & mask
    yield np.arange(len(cell)), cell
    for segment in range(BITS // 2):
        low, high = np.uint64(1 << 2 * segment), np.uint64(2 << 2 * segment)
        if not mask & low:
            continue
        none, full = (cell & low) == 0, (cell & high) != 0
        one = ~none & ~full
        for rows, bits in ((none, low), (one, high), (one, low), (full, high)):
            at = np.flatnonzero(rows)
            yield at, cell[at] ^ bits


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mix = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        x = batch.column("a").to_numpy()
        unary = embed(x.view(np.uint64))
        for k, mask in enumerate(blocks()):
            for rows, cell in steps(unary, mask):
                # cells of the two blocks are told apart by the odd segments
                cell = (cell ^ (cell >> np.uint64(29))) * mix + np.uint64(k)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(x[rows])], names=["cell", "a"])


def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of two tables of fingerprints are within the radius: first the Manhattan bound, then the exact distance."""
    x, y = x[:, 0], y[:, 0]
    near = np.bitwise_count(embed(x) ^ embed(y)) <= RADIUS
    return near & (np.bitwise_count(x ^ y) <= RADIUS)


def within_radius(radius: int):
    """Whether rows of two tables of fingerprints of several words are within a radius: first the Manhattan bound, then the exact distance."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bound = np.bitwise_count(embed(x[..., 0]) ^ embed(y[..., 0]))
        for w in range(1, x.shape[-1]):
            bound += np.bitwise_count(embed(x[..., w]) ^ embed(y[..., w]))
        hit = bound <= radius
        at = np.unravel_index(np.flatnonzero(hit), hit.shape)
        if len(at[0]):
            x, y = np.broadcast_arrays(x, y)
            hit[at] = np.bitwise_count(x[at] ^ y[at]).sum(axis=-1, dtype=np.int64) <= radius
        return hit

    return near


def spanning(x: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect what is connected among distinct fingerprints, breadth first."""
    rest = np.arange(len(x))
    us, vs, frontier = [], [], []
    while len(rest):
        if not frontier:
            frontier.append(rest[0])
            rest = rest[1:]
        one = frontier.pop()
        hit = near(x[rest], x[one : one + 1])
        if hit.any():
            found = rest[hit]
            us.append(found)
            vs.append(np.full(len(found), one))
            frontier.extend(found.tolist())
            rest = rest[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


#: Rows compared at once, and with how many; from so many on the rows of a cell are told apart by the bits of its block.
LOT, TILE, LARGE = 64, 2048, 3 << 12


def forest(x: np.ndarray, near, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``spanning``, for cells of which few are linked: a lot of rows is compared at once with all that is left.

    What a row of the lot is linked to is then searched breadth first to the end, so a dense group costs about its size here too;
    lots start small and are small again after one, as all their rows would be linked to all of it.  With ``part``, the bits
    of the cell's block, rows are compared only if at most two of these differ: other links meet in another block.
    """
    rest = np.arange(len(x))
    if part is not None:
        values, codes = np.unique(part, axis=0, return_inverse=True)
        rest = np.argsort(codes, kind="stable")

    def around(ones: np.ndarray, others: np.ndarray) -> np.ndarray:
        if part is None:
            return others
        own = values[np.unique(codes[ones])]
        within = (np.bitwise_count(own[:, None] ^ values[None]).sum(axis=-1) <= 2).any(axis=0)
        return others[within[codes[others]]]

    def hits(ones: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(others), TILE):
            hit = near(x[ones][:, None], x[others[k : k + TILE]][None])
            at = np.flatnonzero(hit)
            if len(at):
                i, j = np.divmod(at, hit.shape[1])
                found.append((i, j + k))
        i, j = (np.concatenate(y) for y in zip(*found))
        return i, j

    gone, lot = np.zeros(len(x), bool), LOT // 8
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rest):
        # the lot comes first among those around it
        pool = around(rest[:lot], rest)
        i, j = hits(rest[:lot], pool)
        i, j = i[j > i], j[j > i]
        for one in np.unique(i).tolist():
            if gone[rest[one]]:
                continue
            gone[rest[one]] = True
            found = pool[j[i == one]]
            found = found[~gone[found]]
            us.append(found)
            vs.append(np.full(len(found), rest[one]))
            gone[found] = True
            frontier = found
            while len(frontier):
                ones, frontier = frontier[:LOT], frontier[LOT:]
                others = around(ones, rest[~gone[rest]])
                a, b = hits(ones, others)
                b, first = np.unique(b, return_index=True)
                us.append(others[b])
                vs.append(ones[a[first]])
                gone[others[b]] = True
                frontier = np.concatenate([frontier, others[b]])
        gone[rest[:lot]] = True
        rest = rest[~gone[rest]]
        lot = min(2 * lot, LOT) if len(i) <= 8 * lot else LOT // 8
    return np.concatenate(us), np.concatenate(vs)


SMALL = 24


def _links(names: list[str], near, span):
    """Links of sorted (cell, fingerprint) rows, the fingerprint in one or more words; a cell that goes on in the next batch is held back."""

    def search(cell: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.concatenate([first, [len(cell)]]))
        for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
            u, v = span(x[a : a + n], int(cell[a]))
            us.append(u + a)
            vs.append(v + a)
        few = np.flatnonzero(np.repeat(size <= SMALL, size))
        cell = cell[few]
        for d in range(1, SMALL):
            at = np.flatnonzero(cell[d:] == cell[:-d])
            if not len(at):
                break
            at = at[near(x[few[at]], x[few[at + d]])]
            us.append(few[at])
            vs.append(few[at + d])
        u, v = x[np.concatenate(us)].view(np.int64), x[np.concatenate(vs)].view(np.int64)
        pairs = np.unique(np.concatenate([u, v], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in range(pairs.shape[1])], names=[*(f"u{n}" for n in names), *(f"v{n}" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            held.append((cell, np.stack([batch.column(n).to_numpy().view(np.uint64) for n in names], axis=1)))
            rows += len(cell)
            if rows >= 1 << 16 and held[0][0][0] != cell[-1]:
                cell, x = (np.concatenate(y) for y in zip(*held))
                cut = int(np.searchsorted(cell, cell[-1], "left"))
                yield search(cell[:cut], x[:cut])
                held, rows = [(cell[cut:], x[cut:])], len(cell) - cut
        if held:
            yield search(*(np.concatenate(y) for y in zip(*held)))

    return run


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(u, v): links that span every component of the distinct fingerprints ``fp``."""
    cells = distinct.select(F.col("fp").alias("a")).mapInArrow(_cells, "cell long, a long")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(["a"], close, lambda x, cell: spanning(x, close)), "ua long, va long").distinct().toDF("u", "v")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): the hexadecimal fingerprint and the least id reachable by links."""
    rows = materialise(fingerprints(df, id_col, text_col, width), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("__id").alias("least"))
    components = materialise(connected_components(fingerprint_links(classes)), "components")
    rooted = classes.join(components.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(whole, "root").select("fp", "component_id")
    hexadecimal = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp").select(F.col("__id").alias(id_col), hexadecimal.alias("fingerprint"), "component_id")


def wide_fingerprint(text: bytes, width: int, seed: int = 42) -> bytes:
    """The majority of the bits of the 128-bit hashes of the distinct shingles."""
    words = text.lower().split()
    if not words:
        return bytes(WIDE // 8)
    shingles = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x, seed) for x in shingles), np.uint8).reshape(-1, WIDE // 8)
    ones = np.zeros(WIDE, np.int64)
    for k in range(0, len(hashes), 1 << 13):
        ones += np.unpackbits(hashes[k : k + (1 << 13)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _wide_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, at = flat_texts(part.column("__text"))
                raw = data.tobytes()
                found = np.frombuffer(b"".join(wide_fingerprint(raw[a:b], width) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["__id", "a", "b"])
        release()

    return run


def bits_apart(similarity: float) -> float:
    """The share of bits in which fingerprints of texts differ whose shingles have that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_blocks(count: int) -> np.ndarray:
    """The masks of the blocks over the words of a wide fingerprint: every so many segments."""
    masks = np.zeros((count, WIDE // BITS), np.uint64)
    for segment in range(WIDE // 2):
        word, place = divmod(segment, BITS // 2)
        masks[segment % count, word] |= np.uint64(3 << 2 * place)
    return masks


def _wide_cells(count: int):
    def told(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        # a cell by a hash of its counts and, in the last byte, its block; cells of one hash are searched as one
        mix = np.uint64(0x9E3779B97F4A7C15)
        a = (a ^ (a >> np.uint64(29))) * mix
        a = (a ^ (a >> np.uint64(32)) ^ b) * mix
        return ((a ^ (a >> np.uint64(29))) * mix & ~np.uint64(255)) | np.uint64(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(start, 1 << 13)
                a, b = (embed(part.column(n).to_numpy().view(np.uint64)) for n in ("a", "b"))
                for k, (low, high) in enumerate(wide_blocks(count)):
                    found = [(rows, told(cell, b[rows] & high, k)) for rows, cell in steps(a, low)]
                    # the first is the own cell, which is there already
                    found += [(rows, told(a[rows] & low, cell, k)) for rows, cell in steps(b, high)][1:]
                    rows, cell = (np.concatenate(y) for y in zip(*found))
                    rows = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), part.column("a").take(rows), part.column("b").take(rows)], names=["cell", "a", "b"])

    return run


def _wide_span(count: int, radius: int, large: int = LARGE):
    masks, near = wide_blocks(count), within_radius(radius)

    def span(x: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        return forest(x, near, x & masks[cell & 255] if len(x) >= large else None)

    return span


def similar_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(ua, ub, va, vb): links that span every component of the distinct wide fingerprints ``a``, ``b``.

    Of radius // 3 + 1 blocks one holds a distance of 2 or less, as three or more in each would be beyond the radius.
    """
    count = radius // 3 + 1
    cells = distinct.select("a", "b").mapInArrow(_wide_cells(count), "cell long, a long, b long")
    links = _links(["a", "b"], within_radius(radius), _wide_span(count, radius))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(links, "ua long, ub long, va long, vb long")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): the least id reachable by links between documents whose word shingles are similar.

    Documents link if their wide fingerprints differ in no more bits than texts of that Jaccard similarity
    do on average, and one standard deviation more; five of six pairs at the similarity itself are within, and nearly
    all that are a few points above.  The join over the distinct fingerprints loses none of these links.
    """
    apart = bits_apart(similarity)
    radius = int(WIDE * apart + math.sqrt(WIDE * apart * (1 - apart)))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    rows = materialise(rows.mapInArrow(_wide_rows(width), f"__id {kind}, a long, b long"), "wide")
    classes = materialise(rows.groupBy("a", "b").agg(F.min("__id").alias("least")), "classes")
    found = similar_links(classes, radius)
    node = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    components = materialise(connected_components(found.select(node("ua", "ub").alias("u"), node("va", "vb").alias("v"))), "components")
    own = F.struct("a", "b")
    rooted = classes.join(components.select("node.a", "node.b", "root"), ["a", "b"], "left").withColumn("root", F.coalesce("root", own))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(whole, "root").select("a", "b", "component_id")
    return rows.join(named, ["a", "b"]).select(F.col("__id").alias(id_col), "component_id")
