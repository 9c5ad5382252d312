"""The gold corpus of base.gold_words made a document at a time, for operators that take whole documents or sentences; nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hangul, text
from ..operators.batches import rows_from
from ..operators.patch import Lines
from . import base

_WORD = re.compile(text.NOT_SPACE)
Word = tuple[str, list[str], list[str]]


def documents(spark, sf_dir) -> DataFrame:
    """doc_id and text of the documents in syllables."""
    return base.documents(spark, sf_dir).select("doc_id", hangul.from_latin(F.col("text")).alias("text"))


def rows(docs: DataFrame, fn: Callable[[int, str], Iterable[tuple]], made: str) -> DataFrame:
    """doc_id and the rows that fn makes of each document."""
    own = docs.select("doc_id", F.col("doc_id").alias("doc"), "text")
    return rows_from(own, ["doc_id"], ["doc", "text"], lambda d, t: () if t is None else fn(d, t), made)


def sentences(doc: int, doc_text: str) -> Iterable[tuple[int, list[Word]]]:
    """line_idx and words (raw, morphemes, flawed morphemes) of each line that has any."""
    for line_idx, line in enumerate(doc_text.split("\n")):
        found = _WORD.findall(line)
        if found:
            yield line_idx, [_word(w, (doc * 31 + k) % 7 == 0) for k, w in enumerate(found)]


def _word(raw: str, flawed: bool) -> Word:
    end = raw[-1] if raw[-1] in ".,?!" else ""
    core = raw[:-1] if end else raw
    tail = [end + ("/SP" if end == "," else "/SF")] if end else []
    if not core:
        return raw, tail, tail
    gold = [core + ("/SN" if core.isascii() and core.isdigit() else "/NNG"), *tail]
    return raw, gold, [core + "/NNP", *tail] if flawed else gold


def content(raw: str) -> str:
    """A word's line without its id."""
    last = raw[-1]
    if last not in ".,?!":
        return f"{raw}\t{raw}/SN" if raw.isascii() and raw.isdigit() else f"{raw}\t{raw}/NNG"
    return raw + "\t" + " + ".join(_word(raw, False)[1])


def word_ids(doc: int) -> str:
    """What the ids of a document's words begin with."""
    return "AAAA%04d-" % (doc % 10000 if doc >= 0 else -(-doc % 10000))


BOS, EOS = ("BOS", None, "<p>"), ("EOS", None, "</p>")


def corpus(doc: int, doc_text: str) -> Lines:
    """Typed lines of a document."""
    out: Lines = []
    ids = word_ids(doc)
    for at, words in sentences(doc, doc_text):
        out.append(BOS)
        out += [("WORD", f"{ids}{at * 10000 + k:08d}", content(w[0])) for k, w in enumerate(words)]
        out.append(EOS)
    return out


def corpora(doc: int, doc_text: str) -> tuple[Lines, Lines]:
    """A document's typed lines and an edited version: words changed, gone and new, boundaries merged and split."""
    old: Lines = []
    new: Lines = []
    before, merged, ids = None, False, word_ids(doc)
    for at, line in enumerate(doc_text.split("\n")):
        words = _WORD.findall(line)
        if not words:
            continue
        long = len(words) >= 6
        if before is not None:
            merged = (doc + before) % 5 == 0
            if not merged:
                new.append(EOS)
        if not merged:
            new.append(BOS)
        before = at
        old.append(BOS)
        for k, raw in enumerate(words):
            seq = at * 10000 + k
            own = ("WORD", f"{ids}{seq:08d}", content(raw))
            old.append(own)
            if long:
                if k == 4 and at % 4 == 1:
                    new += [EOS, BOS]
                if k <= 4 or seq % 11 != 3:
                    new.append(("WORD", own[1], own[2] + "X") if seq % 7 == 2 else own)
                if k == 1 and seq % 13 == 5:
                    new.append(("WORD", own[1] + "a", "new"))
            else:
                new.append(("WORD", own[1], own[2] + "X") if seq % 7 == 2 else own)
        old.append(EOS)
    if before is not None:
        new.append(EOS)
    return old, new
