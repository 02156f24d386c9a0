"""The registered queries of this subpackage, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses_of_pages

    records = derivatives(responses_of_pages(table(spark, sf_dir, "pages")))
    columns = ["record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "block_digest", "source_digest", "n_links"]
    return records.select(F.col("key").alias("page_id"), *columns, F.octet_length("block").cast("long").alias("n_bytes"), F.size("headers").cast("long").alias("n_headers"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    spans = remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import classify

    return classify(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents")).select(*columns)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_pieces import decode, encode

    path = tokenizer_path("piece_bpe_32k.model")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))
    return both.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == text).alias("round_trip"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import quality_rules

    return {"op5_host_quality_rules": quality_rules.ORACLE}
