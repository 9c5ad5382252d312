"""Splitting, sampling, shuffling and merging, by key hashes, so that every run agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a head up to which it is broadcast.
MOST_BROADCAST_ROWS = 1_000_000


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on keys alone; plain arithmetic, so that any engine can repeat it."""
    x = F.lit(seed)
    for k in keys:
        x = F.pmod(x * 31 + F.pmod(k.cast("long"), F.lit(1_000_003)) * 7919 + 12345, F.lit(1_000_003))
    return F.pmod(x * 48271, F.lit(1_000_003)) / 1_000_003.0


def sample(df: DataFrame, rate: float, *keys: str, seed: int = 0) -> DataFrame:
    """Each row with probability rate; all of df unless 0 < rate < 1."""
    return df.where(uniform(*map(F.col, keys), seed=seed) < rate) if 0 < rate < 1 else df


def shuffled(df: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    """df in an order that depends on the hash of its keys."""
    return df.withColumn("__u", uniform(*map(F.col, keys), seed=seed)).orderBy("__u", *keys).drop("__u")


def positional_split(df: DataFrame, order: list[str], n_dev: int, n_test: int) -> DataFrame:
    """df with split: dev for the first n_dev rows in order, test for the next n_test, train for the others.

    Only the first n_dev + n_test rows are ranked (a top-k), so the rest is not sorted. Rows are told apart by `order`, whose columns
    must make a key.
    """
    head = df.select(*order).orderBy(*order).limit(n_dev + n_test)
    ranked = head.withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    few = F.broadcast(ranked) if n_dev + n_test <= MOST_BROADCAST_ROWS else ranked
    return df.join(few, order, "left").withColumn("split", F.when(F.col("__n").isNull(), "train").when(F.col("__n") <= n_dev, "dev").otherwise("test")).drop("__n")


def merge_words(words: DataFrame, sentence: list[str], rate: float, seed: int = 1234, raw: str = "raw", morphs: str = "morphs") -> DataFrame:
    """Neighbouring words of a sentence joined with probability rate, chains included.

    words: sentence columns (numbers), word_idx, raw, morphs. Each word but the first decides whether it joins the one before.
    """
    joins = (F.col("word_idx") > 0) & (uniform(*map(F.col, sentence), F.col("word_idx"), seed=seed) < rate)
    order = Window.partitionBy(*sentence).orderBy("word_idx")
    at = words.withColumn("__run", F.sum(F.when(joins, 0).otherwise(1)).over(order))
    got = at.groupBy(*sentence, "__run").agg(F.array_sort(F.collect_list(F.struct("word_idx", raw, morphs))).alias("w"))
    return got.select(*sentence, (F.col("__run") - 1).cast("int").alias("word_idx"), F.array_join(F.transform("w", lambda x: x[raw]), "").alias(raw), F.array_join(F.transform("w", lambda x: x[morphs]), " + ").alias(morphs))
