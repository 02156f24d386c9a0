"""Catalogue entries from keyword rules: one projection, no joins, no Python."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import ALIASES, DOC_TYPES, NEUTRAL, PUBLISHERS, SETTINGS, SYSTEMS
from ..functions.text import is_unknown, level_range, strip, title_from_filename, title_or_stem, usable_title

SINGLE = "float"


def f32(x: float) -> Column:
    """A single-precision literal; a plain one would widen the arithmetic."""
    return F.lit(x).cast(SINGLE)


def first_match(rules: Sequence[tuple[str, str]], *texts: Column) -> Column:
    """The value of the first needle found, all needles in one text before the next text; null if none is."""
    out = None
    for text in texts:
        for needle, value in rules:
            hit = F.contains(text, F.lit(needle))
            out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def publisher(text: Column) -> Column:
    out = None
    for needles, name in PUBLISHERS:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(text, F.lit(needle))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def describe(probes: DataFrame, systems: Sequence[tuple[str, str]] = SYSTEMS, doc_types: Sequence[tuple[str, str]] = DOC_TYPES, settings: Sequence[str] = SETTINGS) -> DataFrame:
    """Probes (file_name, pdf_title, text, scanned, ...) with the fields of a catalogue entry.

    Each of system, type, setting and level range that is found is a signal;
    confidence is 0.25 and 0.1 a signal, less for scans.
    """
    low = probes.withColumn("__name", F.lower("file_name")).withColumn("__body", F.lower(F.coalesce("text", F.lit(""))))
    hay = F.concat_ws(" ", "__name", "__body")
    found = low.select(
        *probes.columns,
        first_match(systems, F.col("__name"), F.col("__body")).alias("__system"),
        first_match(doc_types, F.col("__name"), F.col("__body")).alias("__type"),
        first_match([(s.lower(), s) for s in settings], hay).alias("__setting"),
        level_range(F.coalesce("text", F.lit(""))).alias("__levels"),
        publisher(hay).alias("publisher"),
    )
    signals = sum((F.col(c).isNotNull().cast("int") for c in ("__system", "__type", "__setting", "__levels")), F.lit(0))
    confidence = (f32(0.25) + f32(0.1) * signals.cast(SINGLE)).cast(SINGLE)
    confidence = F.when(F.col("scanned"), F.greatest(confidence - f32(0.2), f32(0.1))).otherwise(confidence)
    title = F.when(usable_title(F.col("pdf_title")), strip(F.col("pdf_title"))).otherwise(title_from_filename(F.col("file_name")))
    return found.select(
        *probes.columns,
        title.alias("title"),
        F.coalesce("__system", F.lit("system neutral")).alias("game_system"),
        F.coalesce("__type", F.lit("other")).alias("doc_type"),
        F.coalesce("__setting", F.lit("unknown")).alias("setting"),
        F.coalesce("__levels", F.lit("unknown")).alias("level_range"),
        "publisher",
        F.expr("cast(array() as array<string>)").alias("topics"),
        F.lit("").alias("summary"),
        F.least(confidence, f32(0.65)).cast(SINGLE).alias("confidence"),
    )


def canonical(raw: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """One spelling for a system: overrides first (their keys as written), then the aliases, else as it stands, trimmed."""
    key = F.lower(strip(raw))

    def table(names: Mapping[str, str]) -> Column:
        pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
        return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")

    return F.coalesce(table(overrides or {}), table(ALIASES), F.nullif(strip(raw), F.lit("")), F.lit(NEUTRAL))


def clamp(x: Column) -> Column:
    """A confidence between 0 and 1."""
    return F.greatest(F.least(x.cast(SINGLE), f32(1.0)), f32(0.0))


def finish(digests: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Titles that are unknown become the file's stem, confidences are clamped, systems canonical."""
    out = digests.withColumn("title", title_or_stem(F.col("title"), F.col("path"))).withColumn("confidence", clamp(F.col("confidence")))
    return out.withColumn("game_system", canonical(F.col("game_system"), overrides))


def unnamed(digests: DataFrame) -> Column:
    return is_unknown(digests["title"])
