"""Loaders and writers of vocabularies and dictionaries. Each takes lines with line_no, so that any reader will do.

Loaders keep bad entries with `error` set; strict() raises if there are any.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import morphs as M
from ..operators.sizes import small


def strict(df: DataFrame, what: str) -> DataFrame:
    bad = df.where("error is not null").limit(5).collect()
    if bad:
        raise ValueError(f"bad {what}: " + "; ".join(f"line {r['line_no']}: {r['error']}" for r in bad))
    return df.drop("error")


def _entries(lines: DataFrame, any_hash: bool) -> DataFrame:
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#" if any_hash else "# "))


def vocabulary(lines: DataFrame, cutoff: int = 0, specials: int = 0) -> DataFrame:
    """id, entry, freq of `entry[<TAB>freq]` lines, without freq <= cutoff where given; of duplicates the first. Ids follow the specials."""
    cols = F.split("line", "\t")
    got = lines.where(F.col("line") != "").select("line_no", F.get(cols, F.lit(0)).alias("entry"), F.get(cols, F.lit(1)).try_cast("long").alias("freq"))
    got = got.where(F.col("freq").isNull() | (F.col("freq") > cutoff))
    first = got.withColumn("__n", F.row_number().over(Window.partitionBy("entry").orderBy("line_no"))).where("__n = 1")
    return first.select((F.row_number().over(Window.orderBy("line_no")) + specials - 1).alias("id"), "entry", "freq")


def output_tags(main: DataFrame, more: DataFrame) -> DataFrame:
    """num, tag, is_composite: lines of the main file, then of the other, numbered from 1."""
    both = main.select(F.lit(0).alias("part"), "line_no", "line").unionByName(more.select(F.lit(1).alias("part"), "line_no", "line")).where(F.trim("line") != "")
    return both.select(F.row_number().over(Window.orderBy("part", "line_no")).alias("num"), F.trim("line").alias("tag"), F.col("line").contains(":").alias("is_composite"))


def first_tags(vocab: DataFrame) -> DataFrame:
    """tag_out and first_tag of each composite: the number of its first simple tag."""
    simple = vocab.where("not is_composite").select(F.col("tag").alias("__one"), F.col("num").alias("first_tag"))
    return vocab.where("is_composite").select(F.col("num").alias("tag_out"), F.get(F.split("tag", ":"), F.lit(0)).alias("__one")).join(small(simple), "__one").select("tag_out", "first_tag")


def restore_entries(lines: DataFrame) -> DataFrame:
    """line_no, chr, tag, num, vals (array of chr/tag text), error of `chr/TAG:TAG:n<TAB>chr/TAG chr/TAG` lines.

    A number given twice for one (chr, tag) is an error.
    """
    cols = F.split("line", "\t", -1)
    key = F.get(cols, F.lit(0))
    part = lambda i: F.regexp_extract(key, "^(.)/(.+):(\\d+)$", i)
    got = _entries(lines, True).select("line_no", part(1).alias("chr"), part(2).alias("tag"), part(3).try_cast("int").alias("num"), F.split(F.get(cols, F.lit(1)), " ").alias("vals"), ((F.size(cols) == 2) & (part(1) != "")).alias("ok"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("chr", "tag", "num")) > 1
    return got.withColumn("error", F.when(~F.col("ok"), "invalid").when(twice, "duplicate")).drop("ok")


def restore_map(lines: DataFrame) -> DataFrame:
    """key and value text of a restore file."""
    return _entries(lines, True).select(F.get(F.split("line", "\t"), F.lit(0)).alias("key"), F.get(F.split("line", "\t"), F.lit(1)).alias("value"))


def restored_value(val: Column, simple: dict[str, int]) -> Column:
    """struct<chr, tag, bi> of chr/TAG text, TAG being B-X or I-X."""
    tag = F.regexp_extract(val, "/([^/]*)$", 1)
    return F.struct(F.regexp_extract(val, "^(.*)/[^/]*$", 1).alias("chr"), F.array_position(F.array(*map(F.lit, list(simple))), F.substring(tag, 3, 9)).cast("int").alias("tag"), F.when(tag.startswith("I-"), 1).otherwise(0).alias("bi"))


def compile_restore(entries: DataFrame, vocab: DataFrame) -> DataFrame:
    """chr, tag_out, vals array<struct<chr, tag, bi>>, and packed key and values, of parsed entries whose composite tag is in vocab."""
    from ..functions.tags import NUMBER

    v = vocab.select(F.col("tag").alias("__t"), F.col("num").alias("tag_out"))
    got = entries.withColumn("__t", F.concat_ws(":", "tag", "num")).join(small(v), "__t").withColumn("vals", F.transform("vals", lambda x: restored_value(x, NUMBER)))
    pack = lambda x: F.ascii(x["chr"]).cast("long") * 256 + x["bi"] * 128 + x["tag"]
    return got.select("chr", "tag_out", "vals", (F.ascii("chr").cast("long") * 4096 + F.col("tag_out")).alias("key"), F.transform("vals", pack).alias("packed"))


def preanal_entries(lines: DataFrame) -> DataFrame:
    """line_no, word, is_pfx, morphs, error of `word[*]<TAB>morphs` lines; words that occur twice, with or without *, are errors."""
    cols = F.split("line", "\t", -1)
    first = F.trim(F.get(cols, F.lit(0)))
    pfx = first.endswith("*") & (F.char_length(first) > 2)
    word = F.when(pfx, F.substring(first, F.lit(1), F.char_length(first) - 1)).otherwise(first)
    parsed = M.parse(F.trim(F.get(cols, F.lit(1))), delims=False)
    bad = F.get(F.filter(parsed, lambda m: m["error"].isNotNull()), F.lit(0))["error"]
    got = _entries(lines, False).select("line_no", word.alias("word"), pfx.alias("is_pfx"), F.trim(F.get(cols, F.lit(1))).alias("morphs"), F.when(F.size(cols) != 2, "columns").when(word == "", "empty").when(word.contains(" "), "space").otherwise(bad).alias("error"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("word")) > 1
    return got.withColumn("error", F.coalesce("error", F.when(twice, "duplicate")))


def errpatch_entries(lines: DataFrame) -> DataFrame:
    """line_no, raw, wrong, right, error of `raw<TAB>wrong<TAB>right` lines; (raw, wrong) that occur twice are errors."""
    cols = F.split("line", "\t", -1)
    got = _entries(lines, False).select("line_no", F.get(cols, F.lit(0)).alias("raw"), F.get(cols, F.lit(1)).alias("wrong"), F.get(cols, F.lit(2)).alias("right"), (F.size(cols) != 3).alias("bad"))
    side = lambda c: F.exists(M.parse(F.col(c)), lambda m: m["error"].isNotNull())
    twice = F.count(F.lit(1)).over(Window.partitionBy("raw", "wrong")) > 1
    return got.withColumn("error", F.when(F.col("bad"), "columns").when(side("wrong") | side("right"), "morphs").when(twice, "duplicate")).drop("bad")


def align_entries(lines: DataFrame) -> DataFrame:
    """line_no, raw, mrp_chrs, map_nums, error of the M:N alignment dictionary."""
    cols = F.split("line", "\t", -1)
    got = _entries(lines, True).select("line_no", F.get(cols, F.lit(0)).alias("raw"), F.get(cols, F.lit(1)).alias("mrp_chrs"), F.get(cols, F.lit(2)).alias("map_nums"), (F.size(cols) != 3).alias("bad"))
    total = F.aggregate(F.split("map_nums", ""), F.lit(0), lambda a, x: a + F.coalesce(x.try_cast("int"), F.lit(0)))
    counts = (F.char_length("raw") != F.char_length("map_nums")) | (F.size(F.split("mrp_chrs", " +")) != total)
    twice = F.count(F.lit(1)).over(Window.partitionBy("raw", "mrp_chrs")) > 1
    return got.withColumn("error", F.when(F.col("bad"), "columns").when(~F.col("map_nums").rlike("^\\d+$"), "numbers").when(twice, "duplicate").when(counts, "counts")).drop("bad")


def restore_lines(variants: DataFrame) -> DataFrame:
    """Lines of a restore file from chr, tag, num, vals (text)."""
    return variants.select(F.concat(F.col("chr"), F.lit("/"), F.col("tag"), F.lit(":"), F.col("num"), F.lit("\t"), F.col("vals")).alias("value"))


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    return vocab.orderBy("chr").select(F.concat_ws("\t", "chr", "freq").alias("value"))


def append_new(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """old and the entries of new whose key it lacks: a view, so that no source file is rewritten."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


@dataclass(frozen=True)
class Options:
    """Sizes of a model, and stages that can be turned off."""

    window: int = 4
    embed_dim: int = 35
    hidden_dim: int = 320
    vocab_size: int = 5000
    class_num: int = 500
    preanal: bool = True
    errpatch: bool = True
    restore: bool = True

    @staticmethod
    def load(path: str) -> Options:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        out = Options(**{f.name: raw[f.name] for f in fields(Options) if f.name in raw})
        for name in ("window", "embed_dim", "hidden_dim", "vocab_size", "class_num"):
            if not isinstance(getattr(out, name), int) or getattr(out, name) <= 0:
                raise ValueError(f"{name} must be a positive number")
        return out

    def override(self, text: str | None) -> Options:
        """With the stages that a JSON object turns on or off; unknown names are ignored."""
        if not text:
            return self
        raw = json.loads(text)
        if not isinstance(raw, dict):
            raise ValueError("options must be a JSON object")
        known = {k: v for k, v in raw.items() if k in ("preanal", "errpatch", "restore")}
        if bad := [k for k, v in known.items() if not isinstance(v, bool)]:
            raise ValueError(f"{bad[0]} must be true or false")
        return replace(self, **known)
