"""Accuracy, precision, recall and F-score of predicted analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def morph_counts(pairs: DataFrame, key: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row: n_gold, n_pred, n_match over words with two arrays of morphemes. Each row is a word of its own, which key names.

    Morphemes of a word form a set in which one that occurs n > 1 times stands as n numbered ones. So a morpheme seen once on
    one side and several times on the other matches nothing. Words are counted where they are, only sums are shuffled.
    """
    g, p = F.col(gold), F.col(pred)
    times = lambda ms, m: F.size(F.filter(ms, lambda x: x == m))
    both = lambda m: F.when((times(g, m) == 1) & (times(p, m) == 1), 1).when((times(g, m) > 1) & (times(p, m) > 1), F.least(times(g, m), times(p, m))).otherwise(0)
    single = (F.size(g) == 1) & (F.size(p) == 1)
    match = F.when(single, F.coalesce((g[0] == p[0]).cast("int"), F.lit(0))).otherwise(F.aggregate(F.array_distinct(g), F.lit(0), lambda n, m: n + both(m)))
    size = lambda ms: F.when(ms.isNull(), 0).otherwise(F.size(ms))
    cols = ((size(g), "n_gold"), (size(p), "n_pred"), (F.when(g.isNotNull() & p.isNotNull(), match).otherwise(0), "n_match"))
    return pairs.select(*[c.alias(n) for c, n in cols]).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for _, n in cols])


def f_score(counts: DataFrame) -> DataFrame:
    """precision, recall and f_score in per cent."""
    p, r = 100 * F.col("n_match") / F.col("n_pred"), 100 * F.col("n_match") / F.col("n_gold")
    return counts.select("*", F.round(p, 2).alias("precision"), F.round(r, 2).alias("recall"), F.round(2 * p * r / (p + r), 2).alias("f_score"))


def accuracy(words: DataFrame, gold: str = "gold_tags", pred: str = "pred_tags") -> DataFrame:
    """One row: characters, characters right (compared up to the shorter side), words, words right."""
    n = F.least(F.size(gold), F.size(pred))
    right = F.size(F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & (F.get(gold, i) == F.get(pred, i))))
    return words.agg(
        F.sum(F.size(gold)).cast("long").alias("n_chars"), F.sum(right).cast("long").alias("n_chars_right"),
        F.count(F.lit(1)).alias("n_words"), F.sum((F.col(gold) == F.col(pred)).cast("long")).alias("n_words_right"),
    )


def report(counts: DataFrame) -> DataFrame:
    """The scores as a line of text."""
    return f_score(counts).select(F.format_string("precision: %.2f recall: %.2f f-score: %.2f", "precision", "recall", "f_score").alias("report"))


def misaligned(a: DataFrame, b: DataFrame, key: list[str], word: str = "word") -> DataFrame:
    """Positions at which two files do not hold the same word; an empty result says that they can be compared."""
    return a.select(*key, F.col(word).alias("a")).join(b.select(*key, F.col(word).alias("b")), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
