"""The queries op1 to op10: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled good and not toxic."""
    return labels(spark, sf_dir).where("quality = 1 and toxic = 0").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdoc.llm.quality_rules import judge

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    return judge(documents(spark, sf_dir).select("doc_id", "text"), trusted(spark, sf_dir)).select(*columns)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdoc.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomdoc.llm.byte_bpe import round_trip

    trip = round_trip(spark, F.col("text"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return documents(spark, sf_dir).select("doc_id", trip.alias("_r")).select("doc_id", "_r.*")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdoc.llm.licenses import license_struct

    return documents(spark, sf_dir).select("doc_id", license_struct(F.col("text")).alias("_r")).select("doc_id", "_r.*")


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdoc.llm.recurrent_lm import score_documents

    return score_documents(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdoc.llm.packing import pack

    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdoc.llm.resampling import resample

    out = resample(documents(spark, sf_dir).select("doc_id", "text"), labels=labels(spark, sf_dir))
    return out.select("doc_id", "log_weight", "noisy", "kept")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdoc.llm.mpeg import digest_struct

    return documents(spark, sf_dir).select("doc_id", digest_struct(F.col("text")).alias("_r")).select("doc_id", "_r.*")


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdoc.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), percent=85, size=5)


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomdoc.llm.line_dedup import drop_lines

    return drop_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_byte_bpe, op4_license_scan, op5_recurrent_lm, op6_best_fit_packing, op7_importance_resampling, op8_media_columns, op9_circulant_minhash, op10_fuzzy_line_dedup)
}
SQL: dict[str, str] = {}
