"""Words and characters of text columns, with character and byte offsets (code points; UTF-8 bytes)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batches import rows_of, with_columns
from . import scan

#: What separates words in the analyzer, and nothing else: no form feed, no no-break space.
SPACES = " \t\x0b\r\n　"
NOT_SPACE = "[^ \\t\\x0B\\r\\n\\u3000]+"
#: Characters that are sent as rows at once.
MOST_CHARS = 1 << 16
#: What separates words in training data: all Unicode white space.
TRAIN_NOT_SPACE = "[^\\s\\x1c-\\x1f\\x85\\p{Z}]+"


def is_space(chr_: Column) -> Column:
    return chr_.isin(*SPACES)


def chars(text: Column) -> Column:
    """The characters of text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def words(text: Column, trainer: bool = False) -> Column:
    """The words of text; none for blank text, null for null."""
    return F.regexp_extract_all(text, F.lit(f"({TRAIN_NOT_SPACE if trainer else NOT_SPACE})"), F.lit(1))


def lines(df: DataFrame, text: str, *keep: str, line: str = "line", index: str = "line_idx") -> DataFrame:
    """One row for each line of a text column: a line is a sentence."""
    return df.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias(index, line))


def tokenize(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each word of a text column, up to its first NUL: word_idx, lex, c_begin, c_len, b_begin, b_len."""

    def fn(texts: list[str]) -> tuple:
        w = scan.Scan(texts).words()
        return w["owner"], [pa.array(w[k], pa.int32()) if k != "lex" else w[k] for k in ("word_idx", "lex", "c_begin", "c_len", "b_begin", "b_len")]

    return rows_of(df, list(keep), text, fn, "word_idx int, lex string, c_begin int, c_len int, b_begin int, b_len int")


def char_table(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each character, up to the first NUL: char_idx, chr, b_begin, b_end."""

    def fn(texts: list[str]):
        for c in scan.Scan(texts).chars(MOST_CHARS):
            yield c["owner"], [pa.array(c[k], pa.int32()) if k != "chr" else c[k] for k in ("char_idx", "chr", "b_begin", "b_end")]

    return rows_of(df, list(keep), text, fn, "char_idx int, chr string, b_begin int, b_end int")


def byte_to_char(df: DataFrame, text: str, places: str, into: str, **more: str) -> DataFrame:
    """df with `into`: for each byte offset in the array `places` the number of the character that begins there. more: other arrays, and the columns for them, in the same pass."""
    every = {places: into, **more}
    return with_columns(df, [text, *every], lambda cols: [scan.chars_at_bytes(cols[0], c) for c in cols[1:]], ", ".join(f"`{x}` array<int>" for x in every.values()))


def split_trailing(text: Column, delim: str) -> Column:
    """Fields of text; one empty field at the end is dropped."""
    parts = F.split(text, F.lit("\\Q" + delim + "\\E"), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, "\\p{Nd}", "0")
