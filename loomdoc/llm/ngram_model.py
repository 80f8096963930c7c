"""Hashed n-gram multinomials of trusted-target and raw text, and their log-ratio, with DataFrame functions alone.

A text's n-grams are its words `[^\\x20\\x09-\\x0D]+` and its pairs of neighbouring words, hashed into a fixed number of
buckets. Counts over all documents come back as one row a bucket, so what reaches the driver is bounded by the number of
buckets, a parameter. The ratios go into the plan as one constant array; scoring is a projection without any shuffle.

No text is shuffled at any size: the labelled documents that a model learns from are at most LABELLED (a parameter; beyond
it a sample by a hash of doc_id, the same for any split of the table), so their ids are broadcast and rows are marked in
the same projection that counts them. Raw counts always cover all documents.

Cases. Null or empty text: no n-grams, ratio 0. No target documents: every ratio is 0. Very long texts: linear in the
words. Repeated rows: each counts. A doc_id with several labels is a target if any of them says so. Null doc_id in labels:
ignored, as no document is known by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import SPACE, fresh

BUCKETS = 1 << 15
#: Labelled documents are scored by models of the other folds where a cut is fitted on them.
FOLDS = 2
#: The most labelled documents that a model learns from.
LABELLED = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bind(value: Column, use) -> Column:
    """use(value) with value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def one_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def next_hashes(hashes: Column, step: int = 1) -> Column:
    """Each hash mixed with the one `step` places on, the last ones with none."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def sampled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """labels, one row for each doc_id, or of more than `most` those with the smallest hashes, some `most` of them."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.where(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 40)) < F.lit(int((1 << 40) * (most / n))))


def ngram_counts(rows: DataFrame, text: Column, counted: dict[str, Column], buckets: int) -> list:
    """For each bucket g, how many n-grams of text each column of counted is not null for."""
    one, two = fresh(rows, "one"), fresh(rows, "two")
    hashed = rows.select(*[c.alias(name) for name, c in counted.items()], one_hashes(words_of(text)).alias(one)).withColumn(two, next_hashes(F.col(one)))
    # outer: a plain explode would hash every text once more to filter empty lists
    grams = hashed.select(*counted, F.explode_outer(F.concat(one, two)).alias("g"))
    counts = grams.groupBy(bucket(F.col("g"), buckets).alias("g")).agg(*[F.count(name).alias(name) for name in counted])
    return [c for c in counts.collect() if c.g is not None]


def smoothed(counts: list[tuple[int, int, int]], buckets: int, prior: float) -> list[float]:
    """log p_target - log p_raw of each bucket from (bucket, raw count, target count)."""
    total_r, total_t = sum(r for _, r, _ in counts), sum(t for _, _, t in counts)
    out = [0.0] * buckets
    if total_t:
        for g, r, t in counts:  # the raw share is the prior's mean: rare n-grams say little
            out[g] = math.log(t + prior) - math.log(r * total_t / total_r + prior)
    return out


def log_ratios(docs: DataFrame, target_ids: DataFrame, *, buckets: int = BUCKETS, prior: float = 20.0, most: int = LABELLED, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """log p_target - log p_raw of each bucket; raw text is all documents. target_ids: one column, doc_id."""
    trusted = sampled(target_ids.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct(), most).withColumn("_t", F.lit(1))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(trusted), "_id", "left")
    counts = ngram_counts(rows, F.col("_text"), {"r": F.lit(1), "t": F.col("_t")}, buckets)
    return smoothed([(c.g, c.r, c.t) for c in counts], buckets, prior)


def labelled_rows(docs: DataFrame, labels: DataFrame, *, most: int = LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The labelled documents: _text, good, target (null where not so) and fold. A doc_id's best label counts."""
    good, target = F.col("quality") == 1, (F.col("quality") == 1) & (F.col("toxic") == 0)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(good, 1)).alias("good"), F.max(F.when(target, 1)).alias("target"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sampled(known, most)), "_id")
    return rows.withColumn("fold", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int")).drop("_id")


def labelled_ratios(rows: DataFrame, *, buckets: int = BUCKETS, prior: float = 20.0) -> list[list[float]]:
    """Ratios where raw text is the labelled documents alone: of each fold by the other folds, then of all."""
    counted = {f"{c}{k}": F.when(F.col("fold") == k, x) for k in range(FOLDS) for c, x in (("r", F.lit(1)), ("t", F.col("target")))}
    counts = ngram_counts(rows, F.col("_text"), counted, buckets)
    out = []
    for left_out in range(FOLDS + 1):
        used = [k for k in range(FOLDS) if k != left_out]
        out.append(smoothed([(c.g, r, sum(c[f"t{k}"] for k in used)) for c in counts if (r := sum(c[f"r{k}"] for k in used))], buckets, prior))
    return out


def table_of(ratios: list[float]) -> Column:
    """The ratios as one constant array."""
    return F.split(F.lit(",".join(f"{x:.5g}" for x in ratios)), ",").cast("array<double>")


def log_ratio(one: Column, two: Column, table: Column, buckets: int = BUCKETS) -> Column:
    """The sum of the ratios of a text's n-grams: one_hashes of its words, and next_hashes of those. The table, which is
    large, stands in the plan once."""
    def summed(t: Column) -> Column:
        add = lambda acc, g: acc + F.get(t, bucket(g, buckets))
        return F.aggregate(two, F.aggregate(one, F.lit(0.0), add), add)

    return bind(table, summed)
