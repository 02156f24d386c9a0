"""The digest log: last entry wins, documents are matched against it, entries are re-keyed and dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_unknown


def last_wins(log: DataFrame, key: str = "hash", seq: str = "seq") -> DataFrame:
    """The latest entry of every key.  A maximum of structs is taken partly before the shuffle."""
    row = F.struct(F.col(seq).alias("__seq"), F.struct(*log.columns).alias("row"))
    return log.groupBy(key).agg(F.max(row).alias("m")).select("m.row.*")


def split_pending(docs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the cached descriptions with the documents' present paths, the documents that have none)."""
    described = cache.drop("path").join(docs.select("hash", "path"), "hash")
    return described, docs.join(cache.select("hash"), "hash", "left_anti")


def rekey(cache: DataFrame, docs: DataFrame) -> DataFrame:
    """The cache with entries moved to the hashes that their paths have now.

    An entry moves to a document of its path whose hash the cache does not know.  Each entry moves
    once, to the least such hash; of several entries of a path the one with the greatest
    ``seq`` moves.  A moved entry is gone from its old hash, even if a document has that.
    """
    unknown = docs.select("path", F.col("hash").alias("new_hash")).join(cache.select(F.col("hash").alias("new_hash")), "new_hash", "left_anti")
    unknown = unknown.groupBy("path").agg(F.min("new_hash").alias("new_hash"))
    movers = cache.groupBy("path").agg(F.max(F.struct("seq", "hash")).alias("m")).select("path", F.col("m.hash").alias("hash"))
    moves = movers.join(unknown, "path").select("hash", "new_hash")
    # a hash takes one entry: the one of the least path
    moves = moves.groupBy("new_hash").agg(F.min("hash").alias("hash"))
    columns = [c for c in cache.columns if c != "hash"]
    return cache.join(moves, "hash", "left").select(F.coalesce("new_hash", "hash").alias("hash"), *columns).select(*cache.columns)


def drop_below(cache: DataFrame, confidence: float) -> DataFrame:
    return cache.filter(F.col("confidence") >= F.lit(confidence).cast("float"))


def drop_unnamed(cache: DataFrame) -> DataFrame:
    return cache.filter(~is_unknown(F.col("title")))


def state(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: cached entries, documents that have one, documents that need one."""
    marked = docs.join(cache.select("hash", F.lit(True).alias("known")).distinct(), "hash", "left")
    rows = marked.select(F.when(F.col("known"), "described").otherwise("pending").alias("what")).unionByName(cache.select(F.lit("entries").alias("what")))
    return rows.agg(*(F.count_if(F.col("what") == n).alias(n) for n in ("described", "pending", "entries")))
