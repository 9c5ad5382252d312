"""Dictionary matching as joins, for dictionaries too large to send to every worker: prefixes made equi-joins, pre-analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import small


def longest_key(dic: DataFrame, key: str) -> int:
    return dic.agg(F.max(F.char_length(key))).first()[0] or 0


def common_prefixes(df: DataFrame, text: str, dic: DataFrame, key: str = "key") -> DataFrame:
    """df with every entry of dic whose key is a prefix of text, and its length key_len.

    A prefix join would compare each text with each key. Here each text sends its prefixes, up to the longest key, into an
    equi-join.
    """
    most = longest_key(dic, key)
    each = df.withColumn("key_len", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(most, 1)), F.char_length(text))))).where(F.char_length(text) > 0)
    return each.withColumn(key, F.substring(F.col(text), F.lit(1), F.col("key_len"))).join(small(dic), key)


def longest_prefix(df: DataFrame, text: str, dic: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """For each row of df, named by the columns `by`, the longest entry that is a prefix of text; rows without one are left out."""
    values = [c for c in dic.columns if c != key]
    found = common_prefixes(df, text, dic, key)
    best = found.groupBy(*by, text).agg(F.max(F.struct("key_len", key, *values)).alias("best"))
    return best.select(*by, text, "best.*")


def apply_preanal(words: DataFrame, word: str, dic: DataFrame) -> DataFrame:
    """words with tag_nums: the tags of the longest acceptable entry (0 where none), one for each character.

    dic: key, is_pfx, tag_nums. An exact entry must span the word; a prefix entry tags its own characters. Each distinct
    word is looked up once.
    """
    distinct = words.select(F.col(word).alias("__word")).where(F.col(word).isNotNull()).distinct()
    ok = F.col("is_pfx") | (F.col("key_len") == F.char_length("__word"))
    best = common_prefixes(distinct, "__word", dic).where(ok).groupBy("__word").agg(F.max_by("tag_nums", "key_len").alias("__tags"))
    n = F.char_length(word)
    none = F.array().cast("array<int>")
    fill = F.when(n > F.size(F.coalesce("__tags", none)), F.array_repeat(F.lit(0), n - F.size(F.coalesce("__tags", none)))).otherwise(none)
    return words.join(best, words[word] == F.col("__word"), "left").withColumn("tag_nums", F.concat(F.coalesce(F.col("__tags").cast("array<int>"), none), fill)).drop("__word", "__tags")
