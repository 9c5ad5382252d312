"""Repairs of gold-corpus words: sentence boundaries, case, quotes, symbols. Every repair is a column expression.

Words have raw and morph_list, array<struct<lex, tag>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.morphs import WORD_ID, raw_of

M = "struct<lex:string,tag:string>"
QUOTES, QUOTE_CLASS = "\"“”'‘’`", "\"\"\"''''"


def _tags(morphs: Column) -> Column:
    return F.array_join(F.regexp_extract_all(morphs, F.lit("/([^/ ]+)(?= \\+ |$)"), F.lit(1)), "+")


def is_correct_end(morphs: Column) -> Column:
    """Whether a word's analysis, as text, may end a sentence."""
    t = _tags(morphs)
    return morphs.rlike("^.+/EF \\+ ./SF$") | morphs.rlike("^.+/SF \\+ ['\"’”」\\]]/SS$") | t.endswith("+SF+SS+JKQ") | t.endswith("+SF+SS+VCP+ETM")


def is_period_error(wid: Column, morphs: Column) -> Column:
    """Whether a word is one after whose period the sentence was split wrongly: 4.6, S.M."""
    t = _tags(morphs)
    known = F.when(t.contains("SN+SF+SN") & ~t.endswith("+SF"), ~t.contains("XSN+SF+SN")).otherwise(t.contains("SL+SF+SL") & ~t.endswith("+SF"))
    return wid.rlike(WORD_ID) & morphs.contains("/SF + ") & ~morphs.rlike("^.+/EF \\+ ./SF$") & ~morphs.rlike("^.+/SF \\+ ['\"’”]/SS$") & known


def _neighbours(lines: DataFrame, file: list[str]) -> DataFrame:
    w = Window.partitionBy(*file).orderBy("line_no")
    cols = F.split("line", "\t", -1)
    word = F.when((F.size(cols) == 3) & F.get(cols, F.lit(0)).rlike(WORD_ID), F.struct(F.get(cols, F.lit(0)).alias("wid"), F.get(cols, F.lit(2)).alias("morphs")))
    return lines.withColumn("__w", word).withColumn("__next", F.lead("line").over(w)).withColumn("__p", F.lag("line").over(w)).withColumn("__pw", F.lag("__w").over(w)).withColumn("__ppw", F.lag("__w", 2).over(w)).withColumn("__n", F.row_number().over(w))


def period_errors(lines: DataFrame, file: list[str]) -> DataFrame:
    """Words with an inner sentence-final symbol that stand before a closing tag but do not end a sentence."""
    at = _neighbours(lines, file)
    bad = F.col("__w.morphs").contains("/SF + ") & F.col("__next").startswith("</") & ~is_correct_end(F.col("__w.morphs"))
    return at.where(bad).select(*file, "line_no", "line")


def without_period_errors(lines: DataFrame, file: list[str]) -> DataFrame:
    """lines without the closing and opening tags that split a sentence after a known error."""
    at = _neighbours(lines, file)
    closes = (F.col("line") == "</p>") & is_period_error(F.col("__pw.wid"), F.col("__pw.morphs"))
    opens = (F.col("line") == "<p>") & (F.col("__p") == "</p>") & is_period_error(F.col("__ppw.wid"), F.col("__ppw.morphs"))
    return at.where((F.col("__n") <= 2) | ~F.coalesce(closes | opens, F.lit(False))).select(*lines.columns)


def recover_case(raw: Column, morphs: Column) -> Column:
    """morphs whose i-th Latin letter is the i-th of raw; unchanged where raw has too few."""
    ours = F.regexp_extract_all(raw, F.lit("([a-zA-Z])"), F.lit(1))
    letters = lambda s: F.char_length(F.regexp_replace(s, "[^a-zA-Z]", ""))

    def one(m: Column, i: Column) -> Column:
        before = letters(F.array_join(F.transform(F.slice(morphs, F.lit(1), i), lambda x: x["lex"]), ""))
        cs = F.split(m["lex"], "")
        lex = F.transform(cs, lambda c, j: F.when(c.rlike("^[a-zA-Z]$"), F.get(ours, before + letters(F.array_join(F.slice(cs, F.lit(1), j), "")))).otherwise(c))
        return F.struct(F.array_join(lex, "").alias("lex"), m["tag"].alias("tag"))

    return F.when(letters(raw_of(morphs)) > F.size(ours), morphs).otherwise(F.transform(morphs, one))


def recover_quotes(raw: Column, morphs: Column) -> Column:
    """morphs whose k-th quote (tag SS) is the k-th of raw; unchanged where numbers or kinds differ."""
    ours = F.regexp_extract_all(raw, F.lit(f"([{QUOTES}])"), F.lit(1))
    is_quote = lambda m: (m["tag"] == "SS") & m["lex"].isin(*QUOTES)
    kind = lambda c: F.translate(c, QUOTES, QUOTE_CLASS)
    theirs = F.filter(morphs, is_quote)
    same = (F.size(ours) == F.size(theirs)) & ~F.exists(F.zip_with(ours, theirs, lambda a, b: kind(a) != kind(b["lex"])), lambda x: x)

    def one(m: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(morphs, F.lit(1), i), is_quote))
        return F.struct(F.when(is_quote(m), F.get(ours, before)).otherwise(m["lex"]).alias("lex"), m["tag"].alias("tag"))

    return F.when(same, F.transform(morphs, one)).otherwise(morphs)


def fix_final_symbol(raw: Column, morphs: Column) -> Column:
    """morphs with the one final symbol that raw has more: a period after EC, a comma, or a quotation mark."""
    flat = raw_of(morphs)
    one_more = raw.startswith(flat) & (F.char_length(raw) == F.char_length(flat) + 1)
    end = F.substring(raw, -1, 1)
    tag = F.when((end == ".") & (F.element_at(morphs, -1)["tag"] == "EC"), "SF").when(end == ",", "SP").when(end == '"', "SS")
    return F.when(tag.isNotNull() & one_more, F.concat(morphs, F.array(F.struct(end.alias("lex"), tag.alias("tag"))))).otherwise(morphs)


def recover_from_raw(raw: Column, morphs: Column) -> Column:
    """morphs with their characters taken from raw in order; null where raw is too short."""

    def one(m: Column, i: Column) -> Column:
        before = F.char_length(F.array_join(F.transform(F.slice(morphs, F.lit(1), i), lambda x: x["lex"]), ""))
        return F.struct(F.substring(raw, before + 1, F.char_length(m["lex"])).alias("lex"), m["tag"].alias("tag"))

    return F.when(F.char_length(raw_of(morphs)) <= F.char_length(raw), F.transform(morphs, one))


def compat_words(line: Column) -> Column:
    """A corpus line with jamo made compatible if it is a word, else as it is."""
    from ..functions.hangul import fix_archaic, to_compat

    return F.when(line.rlike(WORD_ID), to_compat(fix_archaic(line))).otherwise(line)
