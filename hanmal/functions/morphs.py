"""The morpheme grammar: lex/TAG joined by ' + ', with _ and | for word and sentence boundaries."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .tags import TAGS

WORD_ID = "^[0-9A-Z_]{4}\\d{4}-\\d{7,8}"
OPEN_TAGS, CLOSE_TAGS = ["<head>", "<p>", "<l>"], ["</head>", "</p>", "</l>"]
JAMO = "[ᄀ-ᇿ]"


def parse_token(token: Column, delims: bool = True, corpus: bool = False) -> Column:
    """struct<lex, tag, error> of lex/TAG, split at the last slash. A delimiter has an empty tag.

    corpus: also refuses conjoining jamo, and knows no delimiters.
    """
    lex, tag = F.regexp_extract(token, "(?s)^(.*)/([^/]*)$", 1), F.regexp_extract(token, "(?s)^(.*)/([^/]*)$", 2)
    error = F.when(token == "", "empty").when(~token.contains("/"), "no tag").when(lex == "", "no lex")
    if corpus:
        error = error.when(lex.rlike(JAMO), "jamo")
    else:
        error = error.when(lex.contains(" "), "space")
    error = error.when(~tag.isin(*TAGS), "bad tag")
    parsed = F.struct(lex.alias("lex"), tag.alias("tag"), error.alias("error"))
    if not delims or corpus:
        return parsed
    return F.when(token.isin("_", "|"), F.struct(token.alias("lex"), F.lit("").alias("tag"), F.lit(None).cast("string").alias("error"))).otherwise(parsed)


def parse(text: Column, **options: bool) -> Column:
    """Array of parsed morphemes."""
    return F.transform(F.split(text, " \\+ ", -1), lambda x: parse_token(x, **options))


def render(morphs: Column, simple: bool = False) -> Column:
    """Morphemes as text; simple keeps the first letter of each tag."""
    tag = lambda m: F.substring(m["tag"], 1, 1) if simple else m["tag"]
    return F.array_join(F.transform(morphs, lambda m: F.when(m["tag"] == "", m["lex"]).otherwise(F.concat_ws("/", m["lex"], tag(m)))), " + ")


def joined(morphs: Column) -> Column:
    """Morphemes as lex/TAG joined by ' + '. The usual one or two are written out, as a lambda over an array is not compiled."""
    one = lambda m: F.concat_ws("/", m["lex"], m["tag"])
    a, b = F.get(morphs, F.lit(0)), F.get(morphs, F.lit(1))
    return F.when(F.size(morphs) == 1, one(a)).when(F.size(morphs) == 2, F.concat_ws(" + ", one(a), one(b))).otherwise(F.array_join(F.transform(morphs, one), " + "))


def raw_of(morphs: Column) -> Column:
    return F.array_join(F.transform(morphs, lambda m: m["lex"]), "")


def all_tags_known(morphs: Column) -> Column:
    return ~F.exists(morphs, lambda m: ~m["tag"].isin(*TAGS))


def is_delimiter(lex: Column, tag: Column) -> Column:
    return lex.isin("_", "|") & (tag == "")


def split_list(items: Column, delim: str) -> Column:
    """Runs of an array between delimiters; neighbouring delimiters count as one, and a leading one leaves an empty run."""
    step = lambda acc, x: F.when(x == delim, F.struct(acc["out"].alias("out"), F.lit(True).alias("cut"))).otherwise(
        F.struct(F.when(acc["cut"] | (F.size(acc["out"]) == 0), F.concat(F.when(acc["cut"] & (F.size(acc["out"]) == 0), F.array(F.array().cast("array<string>"))).otherwise(F.array().cast("array<array<string>>")), acc["out"], F.array(F.array(x)))).otherwise(F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.concat(F.element_at(acc["out"], -1), F.array(x))))).alias("out"), F.lit(False).alias("cut"))
    )
    return F.aggregate(items, F.struct(F.array().cast("array<array<string>>").alias("out"), F.lit(False).alias("cut")), step, lambda acc: acc["out"])


@F.pandas_udf(BooleanType())
def nfkd_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts have the same compatibility decomposition."""
    n = lambda s: None if s is None else unicodedata.normalize("NFKD", s)
    return pd.Series([None if x is None or y is None else n(x) == n(y) for x, y in zip(a, b, strict=True)], dtype=object)


def looks_alike(raw: Column, morphs: Column) -> Column:
    """Whether raw and the morphemes' characters have one length and one decomposition, but differ."""
    flat = raw_of(morphs)
    return (raw != flat) & (F.char_length(raw) == F.char_length(flat)) & nfkd_equal(raw, flat)


def join_morphs(lex: Column, tag: Column) -> Column:
    return F.concat_ws("/", lex, tag)
