"""The whole plan: documents in, a reviewable set of assignments out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import condense, ink, ink_key, let, little_ink
from ..operators import cachelog, catalog, dedupe, filing, report, taxonomy
from ..sources.shared import settled
from .backend import Backend, Rules
from .config import Config


@dataclass
class Plan:
    """A plan as tables: assignments (hash, path, dest, leaf, title, confidence, reason), leaves, duplicates (hash, kept, other, place), unfiled.

    described has the digests of this run, as they came, for the digest log.
    """

    assignments: DataFrame
    leaves: DataFrame
    duplicates: DataFrame
    unfiled: DataFrame
    digests: DataFrame
    described: DataFrame

    def summary(self) -> DataFrame:
        return report.summary(self.assignments, self.leaves, self.duplicates, self.unfiled)

    def tree(self) -> DataFrame:
        return report.tree_lines(self.assignments)


def probe(docs: DataFrame, config: Config) -> DataFrame:
    """Documents with their text condensed, a key of the whole text, and whether they are scans."""
    text = condense(F.coalesce("text", F.lit("")), config.extract.max_chars)
    about = let(ink(F.col("text")), lambda s: F.struct(ink_key(s, config.dedupe.min_text_chars).alias("key"), little_ink(s, config.extract.scanned_threshold).alias("scanned")))
    probed = docs.withColumn("__about", about).withColumn("text", text)
    return probed.withColumn("text_key", F.col("__about.key")).withColumn("scanned", F.col("__about.scanned")).drop("__about")


def build_plan(docs: DataFrame, config: Config | None = None, backend: Backend | None = None, cache: DataFrame | None = None, limit: int | None = None) -> Plan:
    """The plan for documents (path, hash, bytes, page_count, file_name, pdf_title, text).

    cache: digests by hash from earlier runs, with ``seq``; only documents without one are
    described.  limit takes the first documents by path once exact copies are out.  Texts are
    condensed and hashed where they are read; joins move keys.
    """
    config, backend = config or Config(), backend or Rules()
    # hashes may be made of the texts, so they are kept for all that compares documents
    keys = settled(docs.select("path", "hash"), "keys")
    duplicates = dedupe.exact_copies(keys)
    first = dedupe.exact_dedup(keys)
    if limit is not None:
        first = first.orderBy(F.split("path", "/")).limit(limit)
    first = settled(first, "first")
    probed = probe(docs, config)
    unique = probed.join(first.select("path"), "path", "left_semi").select(*probed.columns)
    pending, known = unique, None
    if cache is not None:
        latest = cachelog.rekey(cachelog.last_wins(cache), unique)
        known, pending = cachelog.split_pending(unique, latest.drop("seq"))
    about = ["hash", "path", "bytes", "page_count", "text_key"]
    fields = ["title", "game_system", "doc_type", "setting", "level_range", "publisher", "topics", "summary", "confidence"]
    # a document is described once, whatever reads it below
    described = settled(backend.digest(pending, config).select(*about, *fields), "described")
    digests = described
    if known is not None:
        digests = digests.unionByName(known.select("hash", *fields).join(unique.select(*about), "hash").select(*about, *fields))
    unfiled = settled(first.select("hash", "path").join(digests.select("hash"), "hash", "left_anti").select("path", F.lit("no answer").alias("reason")), "unfiled")
    digests = catalog.finish(digests, config.systems.aliases)
    if config.dedupe.near_duplicates:
        digests, folded = dedupe.near_dedup(digests, config.dedupe.size_tolerance, config.dedupe.min_text_chars)
        duplicates = duplicates.unionByName(folded)
        duplicates = settled(duplicates, "duplicates")
    digests = settled(digests.drop("text_key"), "digests")
    leaves = settled(taxonomy.complete(backend.design(digests, config), digests), "leaves")
    filings = settled(filing.gate(backend.file(digests, leaves, config), config.taxonomy.min_confidence), "filings")
    folded = taxonomy.fold_thin(filings, config.taxonomy.min_docs_per_leaf)
    leaves = taxonomy.leaves_after(leaves, filings, folded, config.taxonomy.min_docs_per_leaf)
    placed = settled(filing.assign_paths(folded), "placed")
    assignments = placed.select("hash", "path", "dest", F.col("folder").alias("leaf"), "title", F.col("filing_confidence").alias("confidence"), "reason")
    return Plan(assignments, leaves, duplicates, unfiled, digests, described)


def plan_document(plan: Plan, source_root: str, library_root: str, mode: str) -> DataFrame:
    """The plan as one JSON value, for files; it gathers the plan, so it is for collections that one reads through."""
    rows = lambda df, order: df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))).alias("j")).first()["j"]
    spark = plan.assignments.sparkSession
    body = [("source_root", source_root), ("library_root", library_root), ("mode", mode)]
    parts = {"assignments": rows(plan.assignments, "dest"), "leaves": rows(plan.leaves, "leaf"), "duplicates": rows(dedupe.nested(plan.duplicates), "kept"), "unfiled": rows(plan.unfiled, "path")}
    text = "{" + ", ".join([f'"{k}": {_quote(v)}' for k, v in body] + [f'"{k}": {v}' for k, v in parts.items()]) + "}"
    return spark.createDataFrame([(text,)], "plan string")


def _quote(x: str) -> str:
    import json

    return json.dumps(x)
