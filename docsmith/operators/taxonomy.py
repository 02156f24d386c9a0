"""The folder taxonomy of a corpus: designed, completed, thinned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import UNSORTED
from ..functions.text import ascii_lower, quoted, title_case


def systems_present(digests: DataFrame) -> DataFrame:
    return digests.select(F.col("game_system").alias("system")).distinct()


def system_totals(digests: DataFrame) -> DataFrame:
    """(system, documents), from the counts by type."""
    counts = digests.groupBy("game_system", "doc_type").agg(F.count("*").alias("n"))
    return counts.groupBy(F.col("game_system").alias("system")).agg(F.sum("n").alias("documents"))


def design(digests: DataFrame, min_docs: int = 3, max_leaves: int = 40) -> DataFrame:
    """(leaf): ``system/Type`` for types with enough documents, ``system/Other`` for all systems, the first ``max_leaves``.

    The limit is the feature: a taxonomy has so many leaves at most.
    """
    counts = digests.groupBy("game_system", "doc_type").agg(F.count("*").alias("n"))
    typed = counts.filter(F.col("n") >= min_docs).select(F.concat_ws("/", "game_system", title_case(F.col("doc_type"))).alias("leaf"))
    other = counts.select(F.concat_ws("/", "game_system", F.lit("Other")).alias("leaf"))
    return typed.unionByName(other).distinct().orderBy("leaf").limit(max_leaves)


def complete(leaves: DataFrame, digests: DataFrame) -> DataFrame:
    """The leaves and a leaf for every system that is no leaf's first step; of spellings that differ in case, one."""
    tops = leaves.select(ascii_lower(F.get(F.split("leaf", "/"), F.lit(0))).alias("top")).distinct()
    missing = systems_present(digests).withColumn("top", ascii_lower(F.col("system"))).join(tops, "top", "left_anti")
    return leaves.unionByName(missing.groupBy("top").agg(F.min("system").alias("leaf")).select("leaf")).distinct()


def fold_thin(filings: DataFrame, min_docs: int = 3) -> DataFrame:
    """Filings whose folder has too few documents move to its parent, once; top folders and the unsorted stay.

    The counts, a row for each folder in use, are broadcast: folders are few, and a join that deals filings out by folder puts nearly all in a few tasks.
    """
    if min_docs <= 1:
        return filings
    counts = filings.groupBy("folder").agg(F.count("*").alias("__n")).withColumnRenamed("folder", "__folder")
    joined = filings.join(F.broadcast(counts), F.col("folder") == F.col("__folder"))
    moved = (F.col("__n") < min_docs) & (F.col("folder") != UNSORTED) & F.contains("folder", F.lit("/"))
    reason = F.concat(F.col("reason"), F.lit("; folded up from thin folder "), quoted(F.col("folder")))
    out = joined.withColumn("reason", F.when(moved, reason).otherwise(F.col("reason")))
    return out.withColumn("folder", F.when(moved, F.regexp_replace("folder", r"(?s)/[^/]*\z", "")).otherwise(F.col("folder"))).drop("__n", "__folder")


def leaves_after(leaves: DataFrame, before: DataFrame, after: DataFrame, min_docs: int = 3) -> DataFrame:
    """The leaves once thin folders are folded: those in use if any moved, else all."""
    thin = before.groupBy("folder").agg(F.count("*").alias("n")).filter((F.col("n") < min_docs) & (F.col("folder") != UNSORTED) & F.contains("folder", F.lit("/")))
    if min_docs <= 1 or thin.isEmpty():
        return leaves
    return after.select(F.col("folder").alias("leaf")).distinct()
