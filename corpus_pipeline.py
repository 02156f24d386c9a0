"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

1. quality classifier: documents that the weakly supervised scorer rejects go;
2. line dedup: of lines within two edits of each other the first stays;
3. SimHash near-dedup: of each group the document with the least id stays;
4. suffix-array dedup: bytes in strings of 200 that occur twice go;
5. best-fit packing: what is left, in sequences of 2048 tokens.

No stage can be put in SQL as a whole, so there is no oracle; tests/llm/test_pipeline.py
holds the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsmith.llm import stages
from docsmith.llm.common import materialise
from docsmith.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.near_duplicates(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.suffixes(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffixes),
    ("best-fit packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k + 1}")
    return docs
