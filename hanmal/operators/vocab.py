"""Vocabularies and dictionaries counted from corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.morphs import joined
from ..functions.text import chars, is_space
from ..functions.tags import SIMPLE, TAGS
from .sizes import small


def char_counts(df: DataFrame, text: str) -> DataFrame:
    """chr and freq of every character that is not a space."""
    return df.select(F.explode(chars(F.col(text))).alias("chr")).where(~is_space(F.col("chr"))).groupBy("chr").agg(F.count(F.lit(1)).alias("freq"))


def with_ids(vocab: DataFrame, min_freq: int = 2, first_id: int = 4) -> DataFrame:
    """id, chr and freq of the characters of at least min_freq, numbered in order of code point after the special ids.

    A vocabulary is bounded by Unicode, so one task may number it.
    """
    return vocab.where(F.col("freq") >= min_freq).select((F.row_number().over(Window.orderBy("chr")) + first_id - 1).alias("id"), "chr", "freq")


def look_up(chars_: DataFrame, vocab: DataFrame, unknown: int = 1) -> DataFrame:
    """chars_ with the id of chr, or `unknown`."""
    return chars_.join(small(vocab.select("chr", "id")), "chr", "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def composite_tags(df: DataFrame, tag: str) -> DataFrame:
    """Distinct output tags that are not B- or I- and a simple tag."""
    return df.select(F.col(tag).alias("tag")).where(~F.substring(F.col("tag"), F.lit(3), F.char_length("tag")).isin(*TAGS)).distinct()


def analyses(words: DataFrame) -> DataFrame:
    """raw, morphs and n of every analysis, with those of prefixes (is_pfx): a word without its last morpheme, if the word ends with it
    and at least four characters remain.

    words: raw, morph_list array<struct<lex, tag>>.
    """
    n = F.size("morph_list")
    last = F.element_at("morph_list", F.greatest(n, F.lit(1)))["lex"]
    cut = F.char_length("raw") - F.char_length(last)
    whole = F.struct(F.col("raw"), joined(F.col("morph_list")).alias("morphs"), F.lit(False).alias("is_pfx"))
    prefix = F.struct(F.substring(F.col("raw"), F.lit(1), cut).alias("raw"), joined(F.slice("morph_list", F.lit(1), F.greatest(n - 1, F.lit(0)))).alias("morphs"), F.lit(True).alias("is_pfx"))
    both = F.when((n >= 2) & F.col("raw").endswith(last) & (cut >= 4), F.array(whole, prefix)).otherwise(F.array(whole))
    return words.where(n > 0).select(F.explode(both).alias("a")).select("a.*").groupBy("raw", "morphs", "is_pfx").agg(F.count(F.lit(1)).alias("n"))


def unambiguous(counted: DataFrame, min_freq: int) -> DataFrame:
    """raw, is_pfx, morphs and freq of what has a single analysis, seen at least min_freq times."""
    one = counted.groupBy("raw", "is_pfx").agg(F.count(F.lit(1)).alias("k"), F.first("morphs").alias("morphs"), F.sum("n").alias("freq"))
    return one.where((F.col("k") == 1) & (F.col("freq") >= min_freq)).drop("k")


def prune(entries: DataFrame) -> DataFrame:
    """entries (raw, is_pfx, morphs, freq) without redundant ones.

    Where a word and a prefix are equal, the prefix stays if both have the same analysis, else the word. Each word also
    deletes the latest prefix before it, in sorted order, if it starts with that prefix in form and analysis and is at
    least as frequent. Prefixes and words are compared within a first character, which keeps the order and lets
    partitions work alone.
    """
    by = Window.partitionBy(F.substring("raw", 1, 1)).orderBy("raw", "is_pfx")
    near = entries.withColumn("after", F.lead(F.struct("raw", "is_pfx", "morphs")).over(by)).withColumn("before", F.lag(F.struct("raw", "is_pfx", "morphs")).over(by))
    twin_after = F.coalesce((~F.col("is_pfx")) & (F.col("after.raw") == F.col("raw")) & F.col("after.is_pfx") & (F.col("after.morphs") == F.col("morphs")), F.lit(False))
    twin_before = F.coalesce(F.col("is_pfx") & (F.col("before.raw") == F.col("raw")) & ~F.col("before.is_pfx") & (F.col("before.morphs") != F.col("morphs")), F.lit(False))
    latest = F.last(F.when(F.col("is_pfx"), F.struct("raw", "morphs", "freq")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("gone", twin_after | twin_before).withColumn("pfx", latest)
    covers = ~F.col("is_pfx") & F.col("raw").startswith(F.col("pfx.raw")) & F.col("morphs").startswith(F.col("pfx.morphs")) & (F.col("pfx.freq") <= F.col("freq"))
    dead = near.where(covers).select(F.col("pfx.raw").alias("raw"), F.lit(True).alias("is_pfx")).distinct()
    return near.where(~F.col("gone")).select("raw", "is_pfx", "morphs", "freq").join(dead, ["raw", "is_pfx"], "left_anti")


def number_variants(pairs: DataFrame, example: str | None = None) -> DataFrame:
    """pairs (chr, tag, vals, pos) with num: variants of each (chr, tag), numbered in order of their first position. example: a column whose value there is kept."""
    more = [F.min_by(example, "pos").alias("example")] if example else []
    first = pairs.groupBy("chr", "tag", "vals").agg(F.min("pos").alias("first_pos"), *more)
    return first.withColumn("num", F.row_number().over(Window.partitionBy("chr", "tag").orderBy("first_pos", "vals")) - 1)


def duplicated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def top_examples(df: DataFrame, key: list[str], example: str, most: int = 10) -> DataFrame:
    """For each key its total, and its `most` most frequent examples with rank and count."""
    n = df.groupBy(*key, example).agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("total", F.sum("n").over(Window.partitionBy(*key))).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), example)))
    return ranked.where(F.col("rank") <= most)


def error_counts(triples: DataFrame, min_freq: int = 10, min_len: int = 4) -> DataFrame:
    """origin, left, right and freq of error patches that are frequent and long enough."""
    return triples.where(F.char_length(F.trim("origin")) >= min_len).groupBy("origin", "left", "right").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_freq)


def output_vocabulary(spark, composites: DataFrame) -> DataFrame:
    """num and tag of every output tag: B- and I- of each simple tag, then the composites (tag) in order. A tag set is bounded by language."""
    simple = spark.createDataFrame([(0, i, t) for i, t in enumerate(SIMPLE)], "part int, pos int, tag string")
    both = simple.unionByName(composites.select(F.lit(1).alias("part"), F.lit(0).alias("pos"), "tag"))
    return both.select("tag", F.row_number().over(Window.orderBy("part", "pos", "tag")).alias("num"))


def by_frequency(counted: DataFrame, freq: str = "freq") -> DataFrame:
    """The most frequent rows first; equal ones in order of their other columns."""
    return counted.orderBy(F.desc(freq), *[c for c in counted.columns if c != freq])
