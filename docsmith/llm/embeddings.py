"""Operator 6, embedding near-duplicates by NN-descent.

Vectors of one label are dealt to cells by random hyperplanes, several times
over with other planes.  In a cell, NN-descent starts from random neighbours and
from neighbours along random projections, and refines the lists through
neighbours of neighbours until hardly any list changes.  A list whose last
entry still reaches the threshold is saturated: it is enlarged, and then compared, in blocks,
with all of the cell outside its component, so a tight group cannot hide a link to another.
Links of all cells together give components; saturated lists are then enlarged
to all of their component, in blocks, so links among a large group are counted and
not listed.  An audit compares the links of a bounded sample with brute force
over all rows: a vector counts if all its partners are found, however many copies they
stand for, and vectors with few partners are held to the bar on their own.  While recall is too low,
more planes are drawn; if ROUNDS draws do not reach it, an error is raised.

Exact copies are one vector with a weight.  Cells hold about ``CELL`` vectors at any input
size (more planes for larger labels, and so many trees that a pair at the threshold shares a cell
of one but for a chance of MISS); blocks of a component hold ``BLOCK`` vectors,
and each pair of blocks is a group of its own.

Edge cases: a vector that is null, zero or holds a null or non-finite component, or
whose label or id is null, links with nothing and is kept; vectors of different length do not
link; an id that comes with several vectors has a row for each; an empty table gives an empty result.  Columns other than id, vector and label are
not carried over.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sorted_groups
from .graph import connected_components

THRESHOLD = 0.93
CELL, BLOCK, PLANES, LIST, AUDIT = 2048, 2048, 4, 8, 256
#: The chance that a pair at the threshold meets in no tree, and how often planes are drawn at most.
MISS, ROUNDS = 0.01, 10


def _prepared(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vec, key): vec of unit length in double precision, or null; key is equal for equal vectors of a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, keys = [], []
            for own, label, values in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("vec").to_pylist()):
                unit = key = None
                if own is not None and label is not None and values and None not in values:
                    x = np.array(values, np.float64)
                    if np.isfinite(x).all() and (largest := np.abs(x).max()) > 0:
                        x = x / largest
                        unit = x / np.sqrt(x @ x)
                        key = hashlib.blake2b(x.tobytes() + f"|{label}".encode(), digest_size=16).digest()
                units.append(unit)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.binary())], names=["id", "label", "vec", "key"])

    kind = df.schema[label_col].dataType.simpleString()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, f"id long, label {kind}, vec array<double>, key binary")


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def descend(x: np.ndarray, threshold: float, size: int = LIST, seed: int = 0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) with i < j at the threshold or above, found by NN-descent over the rows of x."""
    n = len(x)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    rng = np.random.default_rng([seed, n])
    y = x.astype(np.float32)
    size = min(size, n - 1)
    # random neighbours, and those next along two projections
    start = [rng.integers(0, n, (n, size))]
    for _ in range(2):
        order = np.argsort(y @ rng.standard_normal(y.shape[1]).astype(np.float32), kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        start += [order[(place + d) % n][:, None] for d in (1, 2, n - 1, n - 2)]
    everyone = np.arange(n)
    lists, best = _keep(y, everyone, np.concatenate(start, axis=1), size)
    for _ in range(rounds):
        both = _both(lists)
        before = lists
        lists, best = _refine(y, everyone, lists, both, size)
        if (np.sort(before, axis=1) != np.sort(lists, axis=1)).mean() < 0.005:
            break
    i, j, score = np.repeat(everyone, size), lists.ravel(), best.ravel()
    # lists that are full of links are enlarged, as far as their neighbours' neighbours go
    full = np.flatnonzero(best[:, -1] >= threshold)
    wide = min(4 * size, n - 1)
    if len(full) and wide > size:
        more, found = _refine(y, full, lists, _both(lists), wide)
        i, j, score = np.concatenate([i, np.repeat(full, wide)]), np.concatenate([j, more.ravel()]), np.concatenate([score, found.ravel()])
    maybe = (score >= threshold - 1e-3) & (i != j)
    pair = np.unique(np.minimum(i, j)[maybe] * n + np.maximum(i, j)[maybe])
    i, j = pair // n, pair % n
    exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
    i, j = i[exact], j[exact]
    if len(full) and size < n - 1:
        more, others = _bridges(x, full, _roots(n, i, j), threshold)
        i, j = np.concatenate([i, np.minimum(more, others)]), np.concatenate([j, np.maximum(more, others)])
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row is linked to, directly or in turn."""
    root = np.arange(n)
    while True:
        low, after = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _bridges(x: np.ndarray, full: np.ndarray, root: np.ndarray, threshold: float, rows: int = 512, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Links from the rows ``full`` to other components: one at least for each two components that such a row links."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = full[np.argsort(root[full], kind="stable")]
    done = np.zeros(len(x), bool)
    for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        rest = np.flatnonzero((root != root[own[0]]) & ~done)
        for a in range(0, len(own), rows):
            part, met = own[a : a + rows], []
            for b in range(0, len(rest), columns):
                others = rest[b : b + columns]
                u, v = np.nonzero(x[part] @ x[others].T >= threshold)
                hit, first = np.unique(root[others[v]], return_index=True)
                us.append(part[u[first]])
                vs.append(others[v[first]])
                met.append(hit)
            if met:
                # components that are linked by now need no more
                rest = rest[~np.isin(root[rest], np.concatenate(met))]
        done[own] = True
    return np.concatenate(us), np.concatenate(vs)


def _both(lists: np.ndarray) -> np.ndarray:
    """Whom each row lists, and as many at most that list it."""
    n, size = lists.shape
    back = lists.copy()
    back[lists[:, ::-1].ravel(), np.tile(np.arange(size), n)] = np.repeat(np.arange(n), size)
    return np.concatenate([lists, back], axis=1)


def _keep(y: np.ndarray, own: np.ndarray, candidates: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The best distinct candidates of some rows; a row itself only where there are too few."""
    candidates = np.sort(candidates, axis=1)
    score = np.matmul(y[candidates], y[own][:, :, None])[:, :, 0]
    score[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -2
    score[candidates == own[:, None]] = -2
    top = np.argpartition(-score, min(size, score.shape[1]) - 1, axis=1)[:, :size]
    score = np.take_along_axis(score, top, axis=1)
    order = np.argsort(-score, axis=1, kind="stable")
    top, score = np.take_along_axis(top, order, axis=1), np.take_along_axis(score, order, axis=1)
    lists = np.where(score > -2, np.take_along_axis(candidates, top, axis=1), own[:, None])
    return lists, score


def _refine(y: np.ndarray, own: np.ndarray, lists: np.ndarray, both: np.ndarray, size: int, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """New lists of some rows, from their lists and their neighbours' neighbours."""
    out = []
    for a in range(0, len(own), rows):
        part = own[a : a + rows]
        out.append(_keep(y, part, np.concatenate([lists[part], both[both[part]].reshape(len(part), -1)], axis=1), size))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def trees(depth: int, threshold: float, planes: int = PLANES, miss: float = MISS) -> int:
    """How many trees of a depth a pair at the threshold needs to share a cell of one, but for a chance of ``miss``."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** depth
    return planes if together >= 1 else max(planes, math.ceil(math.log(miss) / math.log1p(-together)))


def _cells(planes: int, cell: int, seed: int, threshold: float):
    """Deal each vector to a cell of each tree; a label with n vectors has about n / cell cells a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("id").to_numpy(), batch.column("vec")
            if not len(ids):
                continue
            lengths = vectors.value_lengths().to_numpy()
            depth = np.maximum(0, np.ceil(np.log2(batch.column("n").to_numpy() / cell))).astype(np.int64)
            label = batch.column("label").to_pylist()
            needed = {d: trees(d, threshold, planes) for d in np.unique(depth).tolist()}
            wanted = np.array([needed[d] for d in depth.tolist()])
            for tree in range(int(wanted.max())):
                codes = np.empty(len(ids), object)
                dealt = np.flatnonzero(wanted > tree)
                for dim in np.unique(lengths[dealt]):
                    rows = dealt[lengths[dealt] == dim]
                    x = _matrix(vectors.take(pa.array(rows)))
                    rng = np.random.default_rng([seed, tree, int(dim)])
                    signs = (x @ rng.standard_normal((int(dim), 40))) > 0
                    for row, bits, d in zip(rows, signs, depth[rows]):
                        codes[row] = f"{seed}.{tree}|{label[row]}|{dim}|" + "".join("01"[int(b)] for b in bits[: min(d, 40)])
                take = pa.array(dealt)
                yield pa.RecordBatch.from_arrays([pa.array(codes[dealt], pa.string()), batch.column("id").take(take), vectors.take(take)], names=["cell", "id", "vec"])

    return run


def _descend_cells(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "cell"):
            ids, x = group.column("id").to_numpy(), _matrix(group.column("vec"))
            order = np.argsort(ids, kind="stable")  # the order of arrival must not matter
            ids, x = ids[order], x[order]
            # each tree starts from other neighbours, also where a cell is the whole label
            i, j = descend(x, threshold, seed=zlib.crc32(group.column("cell")[0].as_py().encode()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["u", "v"])

    return run


def graph_links(vectors: DataFrame, threshold: float, planes: int = PLANES, cell: int = CELL, seed: int = 1) -> DataFrame:
    """(u, v): the threshold edges of the neighbour graphs of all cells, over distinct vectors (id, label, vec)."""
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"))
    rows = vectors.join(sizes, "label").select("id", "label", "n", "vec")
    dealt = rows.mapInArrow(_cells(planes, cell, seed, threshold), "cell string, id long, vec array<double>")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_descend_cells(threshold), "u long, v long").distinct()


def _count_blocks(threshold: float):
    """Weighted links of each vector within a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "pair"):
            ids, side, weight, x = group.column("id").to_numpy(), group.column("side").to_numpy(), group.column("weight").to_numpy(), _matrix(group.column("vec"))
            n = np.zeros(len(ids), np.int64)
            # side 0 and 1 are the two blocks; 2 is a block with itself
            sides = [(2, 2)] if (side == 2).any() else [(0, 1), (1, 0)]
            for a, b in sides:
                rows, others = np.flatnonzero(side == a), np.flatnonzero(side == b)
                for k in range(0, len(rows), 512):
                    part = rows[k : k + 512]
                    near = (x[part] @ x[others].T) >= threshold
                    n[part] = near @ weight[others]
                    if a == b:
                        n[part] -= weight[part] * near[np.arange(len(part)), np.searchsorted(others, part)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    return run


def count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, n): weighted links of every vector of (id, root, vec, weight) within its component."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(".", "root", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(pair.alias("pair"), "id", side.cast("int").alias("side"), "weight", "vec")
    counted = dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(_count_blocks(threshold), "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def audit(vectors: DataFrame, links: DataFrame, threshold: float = THRESHOLD, sample: int = AUDIT) -> list[tuple[int, int]]:
    """Of a bounded sample of distinct vectors, how many have partners by brute force and for how many ``links`` (id, n) has all of them.

    Two such pairs: vectors with at most LIST distinct partners, and those with more.
    The sample's size is fixed (``sample`` vectors of least hash), and so is what it costs a row.
    """
    queries = vectors.orderBy(F.xxhash64("id")).limit(sample).select("id", "label", "vec").collect()
    by_label: dict = {}
    for q in queries:
        by_label.setdefault((str(q["label"]), len(q["vec"])), []).append(q)
    probes = {k: (np.array([q["id"] for q in v]), np.array([q["vec"] for q in v])) for k, v in by_label.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weight, lengths = batch.column("id").to_numpy(), batch.column("weight").to_numpy(), batch.column("vec").value_lengths().to_numpy()
            label = np.array([str(x) for x in batch.column("label").to_pylist()], object)
            for (name, dim), (own, q) in probes.items():
                rows = np.flatnonzero((label == name) & (lengths == dim))
                if len(rows):
                    # what rounding could put on either side of the threshold is not held against the links
                    near = (q @ _matrix(batch.column("vec").take(pa.array(rows))).T) >= threshold + 1e-12
                    near &= own[:, None] != ids[rows][None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near @ weight[rows]), pa.array(near.sum(axis=1))], names=["id", "n", "partners"])

    true = vectors.select("id", "label", "vec", "weight").mapInArrow(run, "id long, n long, partners long").groupBy("id").agg(F.sum("n").alias("true"), F.sum("partners").alias("partners"))
    # links within a component are counted in full, so a lower count means that a partner is outside
    whole = (F.coalesce("n", F.lit(0)) >= F.col("true")).cast("int")
    both = true.filter("partners > 0").join(links, "id", "left").groupBy(F.col("partners") <= LIST).agg(F.count("*").alias("n"), F.sum(whole).alias("whole"))
    return [(int(r["n"]), int(r["whole"])) for r in both.collect()]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, least_recall: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each vector."""
    rows = materialise(_prepared(df, id_col, vector_col, label_col), "vectors")
    copies = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
    # nodes go by their vector, so that an id may come with several vectors
    vectors = materialise(copies.withColumn("id", F.xxhash64("key")), "distinct")
    links = None
    for attempt in range(ROUNDS):
        found = graph_links(vectors, threshold, seed=1 + attempt)
        links = materialise(found if links is None else links.unionByName(found).distinct(), "graph")
        components = materialise(connected_components(links), "components")
        members = vectors.join(components.withColumnRenamed("node", "id"), "id").select("id", "root", "vec", "weight")
        counts = materialise(count_links(members, threshold), "counts")
        recall = audit(vectors, counts, threshold)
        if all(whole >= least_recall * n for n, whole in recall):
            break
    else:
        raise RuntimeError(f"after {ROUNDS} draws of planes, (vectors with partners, those with all of them found) in the sample are {recall}: below {least_recall}")
    classes = vectors.select("key", "id", "least", "weight").join(components.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    classes = classes.select("key", "least", F.coalesce("root", "id").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    first = classes.groupBy("root").agg(F.min("least").alias("first"))
    classes = classes.join(first, "root").select("key", "first", "n_links")
    out = rows.select("id", "key").join(classes, "key", "left")
    component = F.coalesce("first", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
