"""The operators as pipeline stages: documents in, documents out, with the same columns.

Other columns may have any name: they travel under names of their own.  A null id is an id like any other, and
rows that share an id are documents of their own unless their texts are equal too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, TEXT = "doc_id", "text"


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _aside(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The documents with all columns but id and text under other names."""
    others = [c for c in docs.columns if c not in (ID, TEXT, "n_chars")]
    carried = tuple(f"carried_{k}" for k in range(len(others)))
    return docs.select(ID, TEXT, *(_named(c).alias(n) for c, n in zip(others, carried))), carried


def _documents(out: DataFrame, docs: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` again; n_chars follows the text."""
    names = iter(carried)
    columns = []
    for f in docs.schema:
        if f.name == "n_chars":
            columns.append(F.length(TEXT).cast(f.dataType).alias("n_chars"))
        else:
            columns.append(F.col(f.name) if f.name in (ID, TEXT) else F.col(next(names)).alias(f.name))
    return out.select(*columns)


def quality(docs: DataFrame) -> DataFrame:
    """The documents that the quality classifier keeps."""
    from .quality_model import keep_good

    names = [f"column_{k}" for k in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    return keep_good(docs.toDF(*names), own[ID], own[TEXT]).toDF(*docs.columns)


def lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that stand earlier in the corpus; n_chars follows the text."""
    from .line_dedup import drop_repeated_lines

    rows, carried = _aside(docs)
    return _documents(drop_repeated_lines(rows, carry=carried), docs, carried)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, by fingerprints over shingles of five words at a similarity of 0.8.

    It is the one with the least id (null before all others) and, of those, the least hash of its text.  Rows equal in id and text
    count as one document.
    """
    from .common import materialise
    from .simhash import similar_documents

    # what tells documents apart: the id and 128 bits of the text
    text = F.coalesce(F.col(TEXT).cast("string"), F.lit(""))
    own = F.struct(F.col(ID).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    rows = docs.select(own.alias("own"), TEXT)
    found = similar_documents(rows, "own", TEXT)
    kept = found.filter(F.col("own") == F.col("component_id")).groupBy("own").agg(F.count("*").alias("n"))
    kept = materialise(kept.select(F.col("own").alias("kept_own"), "n"), "kept")
    names = [f"column_{k}" for k in range(len(docs.columns))]
    whole = docs.select(own.alias("own"), *(_named(c).alias(n) for c, n in zip(docs.columns, names)))
    once = whole.join(kept.filter("n = 1"), F.col("own") == F.col("kept_own"), "left_semi")
    # only where a row is there several times do texts have to meet
    often = whole.join(kept.filter("n > 1"), F.col("own") == F.col("kept_own"), "left_semi").dropDuplicates(["own"])
    return once.unionByName(often).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def suffixes(docs: DataFrame) -> DataFrame:
    """The documents without the bytes of long repeated strings; characters cut in two go whole."""
    from .suffix_dedup import remove_repeats

    rows, carried = _aside(docs)
    out = remove_repeats(rows, carry=carried, whole_characters=True).withColumn(TEXT, F.col("kept").cast("string"))
    return _documents(out, docs, carried)


def packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    from .packing import pack

    return pack(docs, tokenizer)
