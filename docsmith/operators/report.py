"""Reports on a plan: the tree, the summary, what was skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import UNSORTED
from ..functions.text import base_name


def folder_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("leaf").agg(F.count("*").alias("documents"))


def tree_lines(assignments: DataFrame) -> DataFrame:
    """(leaf, depth, line): for every folder the steps that the folder before it does not share.

    The window runs over folders, which are at most as many as the taxonomy has leaves.
    """
    counts = folder_counts(assignments).withColumn("steps", F.split("leaf", "/"))
    before = F.coalesce(F.lag("steps").over(Window.orderBy("leaf")), F.expr("cast(array() as array<string>)"))
    shown = counts.withColumn("before", before)
    same = F.transform("steps", lambda s, k: s.eqNullSafe(F.get("before", k)))
    shared = F.coalesce(F.array_position(same, False) - 1, F.size("steps")).cast("int")
    shown = shown.withColumn("shared", F.when(F.array_position(same, False) > 0, shared).otherwise(F.size("steps")))
    text = lambda s, k: F.concat(F.repeat(F.lit("  "), k), s, F.when(k == F.size("steps") - 1, F.concat(F.lit("/  ("), F.col("documents").cast("string"), F.lit(")"))).otherwise(F.lit("/")))
    rows = shown.select("leaf", "shared", F.posexplode(F.transform("steps", text)).alias("depth", "line"))
    return rows.filter("depth >= shared").select("leaf", "depth", "line")


def document_lines(assignments: DataFrame) -> DataFrame:
    """(leaf, dest, line): a document's line in the full tree, with its old name where that changes."""
    indent = F.repeat(F.lit("  "), F.size(F.split("leaf", "/")))
    to, old = base_name(F.col("dest")), base_name(F.col("path"))
    line = F.concat(indent, to, F.format_string("  [%.2f]", F.col("confidence").cast("double")))
    return assignments.select("leaf", "dest", F.when(to == old, line).otherwise(F.concat(line, F.lit("\n"), indent, F.lit("  was: "), old)).alias("line"))


def summary(assignments: DataFrame, leaves: DataFrame, duplicates: DataFrame, unfiled: DataFrame) -> DataFrame:
    """One row: folders, filed, unsorted, renamed, duplicates (rows of copies), unreadable."""
    main = assignments.agg(
        F.count_if(F.col("leaf") != UNSORTED).alias("filed"),
        F.count_if(F.col("leaf") == UNSORTED).alias("unsorted"),
        F.count_if(base_name(F.col("dest")) != base_name(F.col("path"))).alias("renamed"),
    )
    parts = [
        main.select(F.map_from_arrays(F.array(*(F.lit(c) for c in main.columns)), F.array(*main.columns)).alias("m")),
        leaves.agg(F.create_map(F.lit("folders"), F.count("*")).alias("m")),
        duplicates.agg(F.create_map(F.lit("duplicates"), F.count("*")).alias("m")),
        unfiled.agg(F.create_map(F.lit("unreadable"), F.count("*")).alias("m")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    pairs = rows.select(F.explode("m").alias("k", "v"))
    names = ["folders", "filed", "unsorted", "renamed", "duplicates", "unreadable"]
    return pairs.agg(*(F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names))


def apply_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("documents"))


def first_failures(results: DataFrame, n: int = 10) -> DataFrame:
    """The first failures, and how many there are in all; the limit is the feature."""
    failed = results.filter(F.col("status") == "failed")
    return failed.orderBy("dest").limit(n).select("dest", "error", F.lit(failed.count()).cast("long").alias("failures"))


def skip_summary(skipped: DataFrame) -> DataFrame:
    """(why, documents): reasons without their sources."""
    return skipped.groupBy(F.substring_index("reason", " from ", 1).alias("why")).agg(F.count("*").alias("documents"))
