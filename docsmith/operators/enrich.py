"""What goes back into documents: metadata fields, outlines, and whether a rewrite is to be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import METADATA_OVERWRITE, MODES
from ..functions.text import is_unknown, strip
from .catalog import f32


def may_write(mode: str) -> bool:
    """Only a file of one's own may be changed: not the other name of an original."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return mode in ("copy", "move")


def adjacent_distinct(values: Column) -> Column:
    """An array without values that equal the one before; others may come again."""
    return F.filter(values, lambda x, k: (k == 0) | (x != F.get(values, k - 1)))


def keywords(digest: DataFrame) -> Column:
    facts = F.array("game_system", "doc_type", "setting", "level_range")
    named = F.filter(F.concat(facts, F.col("topics")), lambda x: ~is_unknown(x))
    return F.nullif(F.array_join(F.get(F.transform(F.array(named), adjacent_distinct), F.lit(0)), ", "), F.lit(""))


def metadata_fields(digests: DataFrame) -> DataFrame:
    """Digests with meta_title, meta_author, meta_subject and meta_keywords; null where there is nothing to say."""
    return digests.select(
        "*",
        F.when(~is_unknown(F.col("title")), F.col("title")).alias("meta_title"),
        F.when(~is_unknown(F.col("publisher")), F.col("publisher")).alias("meta_author"),
        F.when(strip(F.col("summary")) != "", F.col("summary")).alias("meta_subject"),
        keywords(digests).alias("meta_keywords"),
    )


def overwrite(old: Column, new: Column, confidence: Column, sure: float = METADATA_OVERWRITE) -> Column:
    """The value to keep: a sure digest replaces, any digest fills what is empty, none leaves as it is."""
    takes = (confidence >= f32(sure)) | (F.coalesce(old, F.lit("")) == "")
    return F.when(new.isNotNull() & takes, new).otherwise(old)


def plausible_rewrite(before: Column, after: Column, max_growth: float = 0.25) -> Column:
    """Whether a rewritten file's size can be right: no less than half, no more than the growth or a MiB above."""
    room = F.greatest((before.cast("float") * f32(max_growth)).cast("long"), F.lit(1 << 20))
    return (before == 0) | ((after >= F.floor(before / 2)) & (after <= before + room))


def wanted(plan: DataFrame, outlines: DataFrame) -> DataFrame:
    """Assignments with the outline known for their hash, where there is metadata or an outline to write."""
    joined = plan.join(outlines.select("hash", "entries"), "hash", "left")
    fields = [F.col(c) for c in ("meta_title", "meta_author", "meta_subject", "meta_keywords") if c in plan.columns]
    return joined.filter(F.coalesce(*fields, F.when(F.size("entries") > 0, "x")).isNotNull())


def outcome(rows: DataFrame) -> DataFrame:
    """One row of counts over (stamped, bookmarks, skipped): documents refreshed, stamped, indexed, bookmarks, skipped."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    done = F.col("skipped").isNull()
    return rows.agg(
        count(done).alias("refreshed"),
        count(done & F.col("stamped")).alias("stamped"),
        count(done & (F.col("bookmarks") > 0)).alias("indexed"),
        F.coalesce(F.sum(F.when(done, F.col("bookmarks"))), F.lit(0)).cast("long").alias("bookmarks"),
        count(~done).alias("skipped"),
    )
