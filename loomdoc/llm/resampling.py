"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A document's log importance weight is log p_target - log p_raw of its n-grams. Each gets Gumbel noise, a function of its
doc_id and the seed, and the k largest sums stay: a sample without replacement in proportion to the weights. k is a share
of the rows, or, with labels, follows from what the rows score: a weight is fitted that best parts good and bad labelled
documents, each scored by a model that has not seen it, and k is the count of all rows that reach it. Raw text is then
the labelled documents alone, so neither weights nor the fitted one move with what unlabelled rows repeat. The cut is
found by radix selection: a histogram of at most 65,536 counts for each 16 bits of the ordered key, so neither a global
sort nor the scores of all documents reach one place.

Cases. Null or empty text: weight 0. Ties in the key: all rows of the cut's key stay. Repeated rows with one doc_id have
one key. Null doc_id: noise of its own. Empty table: no rows. Share 1 or more: all stay. Only good labels, or
no label at all (an empty table, null qualities): all stay. Only bad labels: none stays. Extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import release, staged, sweep
from loomdoc.llm.ngram_model import LABELLED, bind, labelled_ratios, labelled_rows, log_ratio, log_ratios, next_hashes, one_hashes, table_of, words_of


def gumbel(key: Column, seed: int) -> Column:
    unit = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def kth_largest(table: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest of a long column that is not negative; None where there are fewer."""
    prefix = 0
    for shift in (48, 32, 16, 0):
        part = table if shift == 48 else table.where(F.shiftright(key, shift + 16) == prefix)
        counts = part.groupBy(F.shiftright(key, shift).alias("p")).agg(F.count("*").alias("c")).collect()
        for row in sorted(counts, key=lambda r: -r.p):
            if row.c >= k:
                prefix = row.p
                break
            k -= row.c
        else:
            return None
    return prefix


def step(weight: Column) -> Column:
    """The weight in steps of 1 in 1,000 above 1 and 0.001 below: some 30,000 for any weights, in their order."""
    return F.when(weight < 0, -F.ceil(F.log1p(-weight) * 1000)).otherwise(F.floor(F.log1p(weight) * 1000))


def weight(text: Column, tables: list[list[float]], which: Column | None = None) -> Column:
    """The log importance weight of a text by one of the tables."""
    table = table_of(tables[-1])
    for k, t in enumerate(tables[:-1]):
        table = F.when(which == k, table_of(t)).otherwise(table)
    return bind(one_hashes(words_of(text)), lambda one: bind(next_hashes(one), lambda two: log_ratio(one, two, table)))


def fitted_step(rows: DataFrame, ratios: list[list[float]]) -> float:
    """The lowest step from which the share of good labelled documents most exceeds that of bad ones, -inf or inf if all are of one kind."""
    weights = rows.select("good", F.inline_outer(F.array(F.struct(weight(F.col("_text"), ratios, F.col("fold")).alias("w")))))
    counts = weights.groupBy(step(F.col("w")).alias("s")).agg(F.count("good").alias("good"), F.count("*").alias("n")).collect()
    goods, total = sum(c.good for c in counts), sum(c.n for c in counts)
    if goods in (0, total):
        return -math.inf if goods == total else math.inf
    best, at, good, bad = 0.0, math.inf, 0, 0
    for c in sorted(counts, key=lambda c: -c.s):
        good, bad = good + c.good, bad + c.n - c.good
        if good * (total - goods) - bad * goods >= best:
            best, at = good * (total - goods) - bad * goods, c.s
    return at


def resample(docs: DataFrame, target_ids: DataFrame | None = None, *, share: float | None = None, labels: DataFrame | None = None, most: int = LABELLED, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with log_weight, noisy and kept (among the k largest). Either target_ids and share, k = ceil(share * rows), or labels.

    labels: doc_id, quality and toxic; the target is what has quality 1 and toxic 0. Weights are staged without texts to
    find the cut, and made again, the same, beside the rows: no text is moved or written.
    """
    if labels is None:
        ratios, least = log_ratios(docs, target_ids, most=most, doc_id=doc_id, text=text), None
    else:
        rows = labelled_rows(docs, labels, most=most, doc_id=doc_id, text=text)
        *folds, ratios = labelled_ratios(rows)
        sweep(docs.sparkSession)
        least = fitted_step(rows, folds)
    sweep(docs.sparkSession)
    # a generated column: filters on it are not pushed below the work
    scored = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("log_weight", "noisy", "kept")], F.inline_outer(F.array(F.struct(weight(F.col(text), [ratios]).alias("log_weight")))))
    scored = scored.withColumn("noisy", F.col("log_weight") + gumbel(F.col(doc_id), seed))
    # 24 bits before and 24 after the binary point: an order-keeping, non-negative integer
    ordered = F.floor((F.col("noisy") + float(1 << 30)) * float(1 << 24)).cast("long")
    weights = staged(scored.select("log_weight", ordered.alias("key")), "weights")
    if least is None:
        k, whole = math.ceil(share * weights.count()), share >= 1
    else:
        k, whole = weights.where(step(F.col("log_weight")) >= F.lit(least)).count(), least == -math.inf
    cut = kth_largest(weights, "key", k) if k and not whole else None
    release(weights)
    return scored.withColumn("kept", F.lit(True) if whole else F.lit(False) if cut is None else ordered >= cut)
