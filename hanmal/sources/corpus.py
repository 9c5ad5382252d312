"""Readers and writers of corpora. Readers that depend on the order of lines take a table with (file, line_no, line)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import morphs as M
from ..functions.tags import TAGS

_ID, _JAMO, _TAGS = re.compile(M.WORD_ID, re.ASCII), re.compile(M.JAMO), frozenset(TAGS)


# ---- one file, by its lines in order; the functions on tables below say what they do

class Word(NamedTuple):
    sent: int
    word_idx: int
    wid: str
    raw: str | None
    morphs: list[tuple[str, str]] | None
    error: str | None


def parsed(token: str) -> tuple[str, str, str | None]:
    """lex, tag and error of a morpheme (morphs.parse_token for corpora)."""
    lex, slash, tag = token.rpartition("/")
    if not slash:
        return "", "", "no tag" if token else "empty"
    return lex, tag, "no lex" if lex == "" else "jamo" if _JAMO.search(lex) else None if tag in _TAGS else "bad tag"


def file_words(lines: Iterable[str], check_codes: bool = True) -> Iterator[Word]:
    """gold_words of a file."""
    opened = closed = idx = 0
    for line in lines:
        if line in M.OPEN_TAGS:
            opened, idx = opened + 1, 0
        elif line in M.CLOSE_TAGS:
            closed += 1
        if opened <= closed or not _ID.match(line):
            continue
        cols = line.split("\t")
        raw, morphs, error = cols[1] if len(cols) > 1 else None, None, "columns"
        if len(cols) == 3:
            found = [parsed(t) for t in cols[2].split(" + ")]
            morphs = [(x, t) for x, t, _ in found]
            error = "space" if " " in raw else next((e for _, _, e in found if e), None)
        if check_codes and error is None:
            flat = "".join(x for x, _ in morphs)
            if raw != flat and len(raw) == len(flat) and unicodedata.normalize("NFKD", raw) == unicodedata.normalize("NFKD", flat):
                error = "mismatch"
        yield Word(opened - 1, idx, cols[0], raw, morphs, error)
        idx += 1


def good_words(words: Iterable[Word]) -> list[Word]:
    """good_sentences of a file."""
    words = list(words)
    bad = {w.sent for w in words if w.error is not None}
    return [w for w in words if w.sent not in bad]


def file_training_words(lines: list[str], keep_last: bool = False) -> Iterator[tuple[int, int, str, list[str] | None]]:
    """training_words of a file: sent, word_idx, raw and tags."""
    blank = [line.strip(" ") == "" for line in lines]
    last = len(lines) if keep_last else max((i for i, b in enumerate(blank) if b), default=0)
    sent, idx = -1, 0
    for i in range(last):
        if blank[i]:
            idx = 0
            continue
        sent += idx == 0
        cols = lines[i].split("\t")
        yield sent, idx, cols[0], cols[1].split(" ") if len(cols) > 1 else None
        idx += 1


def text_of(words: Iterable[tuple]) -> tuple[str, str]:
    """sentence_text of a sentence's words: raw, and morphemes as text, come first in each."""
    words = list(words)
    return " ".join(w[0] for w in words), " + _ + ".join(" + ".join(w[1]) for w in words)


# ---- tables

def by_file():
    return Window.partitionBy("file").orderBy("line_no")


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", stop: dict[str, str] | None = None) -> DataFrame:
    """file, line_no and line of each text file under path.

    A file is read whole by one task, as its line numbers need all of it; files are read in parallel. stop: for a file name, the line
    after which the rest is ignored.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", encoding).alias("text"))
    text = F.regexp_replace(F.regexp_replace("text", "^\\uFEFF", ""), "\r?\n\\z", "")
    out = raw.select("file", F.posexplode(F.split(text, "\r?\n", -1)).alias("line_no", "line"))
    for name, last in (stop or {}).items():
        end = F.min(F.when(F.col("line") == last, F.col("line_no"))).over(Window.partitionBy("file"))
        out = out.withColumn("__end", end).where((F.col("file") != name) | F.col("__end").isNull() | (F.col("line_no") <= F.col("__end"))).drop("__end")
    return out


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """text of each line: the line source of the analyzer."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def result_lines(words: Column) -> Column:
    """An analysed sentence as text: a line `word<TAB>lex/TAG + lex/TAG` for each word, and a blank one.

    words: array of structs with lex and morphs.
    """
    one = lambda w: F.concat_ws("\t", w["lex"], F.array_join(F.transform(w["morphs"], lambda m: F.concat_ws("/", m["lex"], m["tag"])), " + "))
    return F.concat(F.array_join(F.transform(words, one), "\n"), F.when(F.size(words) > 0, "\n").otherwise(""))


def write_results(analysed: DataFrame, path: str, words: str = "words") -> None:
    analysed.select(result_lines(F.col(words)).alias("value")).write.text(path)


def parse_word(line: Column) -> Column:
    """struct<wid, raw, morphs, error> of a corpus word line with three columns."""
    cols = F.split(line, "\t", -1)
    raw, parsed = F.get(cols, F.lit(1)), M.parse(F.get(cols, F.lit(2)), corpus=True)
    bad = F.get(F.filter(parsed, lambda m: m["error"].isNotNull()), F.lit(0))["error"]
    error = F.when(F.size(cols) != 3, "columns").when(raw.contains(" "), "space").when(bad.isNotNull(), bad)
    morphs = F.transform(parsed, lambda m: F.struct(m["lex"].alias("lex"), m["tag"].alias("tag")))
    return F.struct(F.get(cols, F.lit(0)).alias("wid"), raw.alias("raw"), F.when(F.size(cols) == 3, morphs).alias("morphs"), error.alias("error"))


def mark_mismatch(words: DataFrame) -> DataFrame:
    """words (raw, morphs, error) with the error 'mismatch' where raw and morphemes look alike but are coded differently."""
    return words.withColumn("error", F.coalesce("error", F.when(M.looks_alike(F.col("raw"), F.col("morphs")), "mismatch")))


def gold_words(lines: DataFrame, check_codes: bool = True) -> DataFrame:
    """file, sent, word_idx, wid, raw, morphs, error of the words between sentence tags; sent numbers a file's sentences from 0.

    Filter with good_sentences() to drop sentences that hold a bad word.
    """
    opens = F.sum(F.col("line").isin(*M.OPEN_TAGS).cast("int")).over(by_file())
    closes = F.sum(F.col("line").isin(*M.CLOSE_TAGS).cast("int")).over(by_file())
    at = lines.withColumn("__open", opens).withColumn("__close", closes).where((F.col("__open") > F.col("__close")) & F.col("line").rlike(M.WORD_ID))
    idx = F.row_number().over(Window.partitionBy("file", "__open").orderBy("line_no")) - 1
    out = at.select("file", (F.col("__open") - 1).cast("int").alias("sent"), idx.alias("word_idx"), parse_word(F.col("line")).alias("w")).select("file", "sent", "word_idx", "w.*")
    return mark_mismatch(out) if check_codes else out


def good_sentences(words: DataFrame) -> DataFrame:
    """Words of the sentences without an error."""
    bad = F.max(F.col("error").isNotNull()).over(Window.partitionBy("file", "sent"))
    return words.withColumn("__bad", bad).where("not __bad").drop("__bad", "error")


def errors(words: DataFrame) -> DataFrame:
    return words.where("error is not null")


def blank_separated(lines: DataFrame, keep_last: bool) -> DataFrame:
    """file, sent, word_idx and line of the lines between blank ones. keep_last: whether lines after a file's last blank line count."""
    blank = F.trim("line") == ""
    at = lines.withColumn("__sent", F.sum(blank.cast("int")).over(by_file())).withColumn("__all", F.sum(blank.cast("int")).over(Window.partitionBy("file")))
    at = at.where(~blank)
    if not keep_last:
        at = at.where(F.col("__sent") < F.col("__all"))
    sent = F.dense_rank().over(Window.partitionBy("file").orderBy("__sent")) - 1
    idx = F.row_number().over(Window.partitionBy("file", "__sent").orderBy("line_no")) - 1
    return at.select("file", sent.alias("sent"), idx.alias("word_idx"), "line")


def training_words(lines: DataFrame, keep_last: bool = False) -> DataFrame:
    """file, sent, word_idx, raw and tags of `raw<TAB>tag tag ...` lines."""
    cols = F.split("line", "\t")
    return blank_separated(lines, keep_last).select("file", "sent", "word_idx", F.get(cols, F.lit(0)).alias("raw"), F.split(F.get(cols, F.lit(1)), " ").alias("tags"))


def eval_words(lines: DataFrame) -> DataFrame:
    """file, line_no, word and morphs of `word<TAB>morphs` lines."""
    cols = F.split("line", "\t")
    return lines.where(F.col("line") != "").select("file", "line_no", F.get(cols, F.lit(0)).alias("word"), F.split(F.get(cols, F.lit(1)), " \\+ ").alias("morphs"))


def sentence_text(words: DataFrame, key: list[str]) -> DataFrame:
    """key, raw and morphs of each sentence as text: words joined by spaces, analyses by ' + _ + '."""
    w = F.array_sort(F.collect_list(F.struct("word_idx", "raw", "morphs")))
    got = words.groupBy(*key).agg(w.alias("w"))
    return got.select(*key, F.array_join(F.transform("w", lambda x: x["raw"]), " ").alias("raw"), F.array_join(F.transform("w", lambda x: M.render(x["morphs"])), " + _ + ").alias("morphs"))


def convert(words: DataFrame, to: str) -> DataFrame:
    """Corpus words as lines of another format: raw sentences, or native `raw<TAB>morphs` with sentences apart."""
    if to == "raw":
        return sentence_text(words, ["file", "sent"]).select("file", "sent", F.lit(0).alias("word_idx"), F.col("raw").alias("line"))
    if to == "native":
        return words.select("file", "sent", "word_idx", F.concat_ws("\t", "raw", M.render(F.col("morphs"))).alias("line"))
    raise ValueError(f"unknown format {to}")


def write_split(df: DataFrame, path: str) -> None:
    """One folder for each value of `split`."""
    df.write.partitionBy("split").parquet(path)
