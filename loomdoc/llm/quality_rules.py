"""Quality rules: length-normalised log-likelihood ratio of hashed n-gram multinomials, over plain repetition rules.

All of it is DataFrame functions. A document fails the base rules with fewer than 20 words, or where over 30 in 100 words
lie in 8-word windows that the text has twice or more. Otherwise it is kept if its ratio between the trusted target and
the raw corpus, divided by its n-grams, reaches a fixed threshold; no sampling takes part.

Cases. Null or empty text: 0 words, base_failed. Fewer than 8 words: no windows. Very long texts: windows are sorted,
n log n. Ties at the threshold: kept. Repeated rows: each is judged alike. Empty table: no rows. Extra columns pass
through unread; the names this module adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import sweep
from loomdoc.llm.ngram_model import bind, log_ratio, log_ratios, next_hashes, one_hashes, table_of, words_of

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Set on labelled documents held out of the target at two table sizes: no clean one of them scores lower.
THRESHOLD = -0.1


def repeat_words(pairs: Column) -> Column:
    """Words in 8-word windows that stand twice or more. pairs: the hashes of each word with the next."""
    n_windows = F.greatest(F.size(pairs) - WINDOW + 1, F.lit(0))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            def same(x: Column, j: Column) -> Column:
                return F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(p, lambda x, j: same(x, j + 1) | same(x, j - 1)), lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("n"), (i + WINDOW).alias("end"))
        total = F.aggregate(bind(placed, repeated), start, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total)

    # windows of 2 words make those of 4, and these those of 8
    windows = bind(pairs, lambda two: bind(next_hashes(two, 2), lambda four: next_hashes(four, 4)))
    return bind(F.slice(windows, F.lit(1), n_windows), covered)


def base_columns(text: Column, words: Column, pairs: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(pairs),
    }


def judge(docs: DataFrame, target_ids: DataFrame, *, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept."""
    table = table_of(log_ratios(docs, target_ids, doc_id=doc_id, text=text))
    sweep(docs.sparkSession)

    def measured(words: Column) -> Column:
        def with_pairs(one: Column) -> Column:
            def columns(two: Column) -> Column:
                found = {**base_columns(F.col(text), words, two), "score": log_ratio(one, two, table)}
                return F.struct(*[c.alias(name) for name, c in found.items()])

            return bind(next_hashes(one), columns)

        return bind(one_hashes(words), with_pairs)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
    # generated as rows of one struct: filters on the results are not pushed below the work, so it is done once
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names], F.inline_outer(F.transform(F.array(words_of(F.col(text))), measured)))
    out = out.withColumn("score", F.when(F.col("n_words") > 0, F.col("score") / (2 * F.col("n_words"))).otherwise(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
