"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Work inside a task goes through about this many text bytes at a time.
SLICE_BYTES = 1 << 20


#: The least a batch or shard is meant for, in bytes of the table as its files have it.
BATCH_BYTES = 128 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder path in the folder that all executors share (``spark.checkpoint.dir``); only a local session may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="docsmith-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts_for(df: DataFrame) -> int:
    """Into how many parts a table is dealt: as many as ``spark.sql.shuffle.partitions``, or more, so that a part's share of the files is bounded."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # tables that do not know their size claim to be beyond all measure
    return max(n, -(-size // BATCH_BYTES)) if size < 1 << 60 else n


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; this cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    system, at = _hadoop(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in any store that Spark reads."""
    system, at = _hadoop(spark, path)
    system.delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give freed memory back to the system: a reused worker would keep the most it ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def flat_texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and the offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` text bytes, one row at least."""
    _, at = flat_texts(batch.column(text))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is compressed, for a shuffle: about half the bytes that the shuffle's own codec leaves."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        raw = [squeeze(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        at = batch.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(raw, pa.binary()), *batch.columns[at + 1 :]], names=batch.schema.names)


def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows with their text as it was."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    at = batch.schema.get_field_index("text")
    texts = pa.array([expand(t) for t in batch.column("text").to_pylist()], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=batch.schema.names)


def pack_texts(df: DataFrame) -> DataFrame:
    """A table with a column ``text``, that column compressed."""
    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(packed, fields)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the ragged pieces values[at[i]:at[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each piece, one after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by a column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        if held and held[-1].column(key)[-1].as_py() != codes[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
