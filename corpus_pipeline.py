"""The corpus pipeline: five stages, each by one operator, on all that the stage before kept.

Cases, for every stage. An empty table gives an empty table. Repeated rows are each judged; those of one doc_id and text
stay or go together. A null text counts as empty. A null doc_id is a document like others, but is never labelled, its lines
are not compared, and of a group of near copies it stays only if all are null. Extra columns pass through all stages but
the last; one with the name of a column that the stage's operator adds comes out with the operator's value. Stages do not
depend on the order of rows or on how the table is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import documents, release, staged
from loomdoc.llm.line_dedup import drop_lines
from loomdoc.llm.near_dup import near_duplicates
from loomdoc.llm.packing import pack
from loomdoc.llm.quality_rules import judge
from loomdoc.llm.queries import labels, trusted, vocabulary
from loomdoc.llm.resampling import resample


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: the k documents of the largest noisy weights stay, k being how many reach the weight that best
    parts good from bad labelled documents. No labels, or good ones only: all stay. Bad ones only: none."""
    out = resample(docs, labels=labels(spark, sf_dir))
    return out.where("kept").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that pass the base rules and reach the log-likelihood ratio's threshold. Null and empty texts go, as
    they have fewer than 20 words. No trusted labels: the base rules alone decide."""
    return judge(docs, trusted(spark, sf_dir)).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that an earlier line is a near copy of; n_chars is counted again. A text may
    become empty; a null one stays null with its n_chars."""
    out = drop_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (word shingles of five, similarity 0.80 or more) stays: the one with the group's smallest
    doc_id. Documents without words are in no group and stay."""
    kept = near_duplicates(docs, percent=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of at most 2048 tokens with its place; a null or empty text is one piece, the end token."""
    return pack(docs, vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: No stage is SQL (hashed models, MinHash, packing); tests/llm/test_pipeline.py holds stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out  # pieces are staged by their operator: documents are not read again
        before, docs = docs, staged(out, name)
        if i:
            release(before)
    return docs
