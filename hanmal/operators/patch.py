"""Corpus patches: the difference of two versions of a corpus, and its application.

A corpus is a table of lines: doc, line_no, type (WORD, BOS, EOS, MISC), wid, content. A patch is doc, op (= + - S M), wid, content.
Documents are patched one by one, in parallel: a table is shuffled once, by document, and not at all where each row already holds a document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import rows_from

#: Characters of a word id that sentence patches compare.
ID_LEN = 17
#: Lines of a document in order: type, wid, content. Its patches: op, wid, content.
Lines = list[tuple[str, str | None, str | None]]
Patches = list[tuple[str, str | None, str | None]]
PATCH, LINE = "op string, wid string, content string", "line_no int, type string, wid string, content string"


def type_lines(lines: DataFrame) -> DataFrame:
    """Types the raw lines (doc, line_no, line) of a corpus."""
    from ..functions.morphs import CLOSE_TAGS, OPEN_TAGS, WORD_ID

    is_word = F.col("line").rlike(WORD_ID) & F.col("line").contains("\t")
    kind = F.when(is_word, "WORD").when(F.col("line").isin(*OPEN_TAGS), "BOS").when(F.col("line").isin(*CLOSE_TAGS), "EOS").otherwise("MISC")
    at = F.instr("line", "\t")
    return lines.select("doc", "line_no", kind.alias("type"), F.when(is_word, F.substring(F.col("line"), F.lit(1), at - 1)).alias("wid"), F.when(is_word, F.substring(F.col("line"), at + 1, F.char_length("line"))).otherwise(F.col("line")).alias("content"))


# ---- one document

def document_words(old: Lines, new: Lines) -> Patches:
    """Words changed (=), gone (-) and new (+). A null id is nobody else's."""
    theirs: dict[str | None, list] = {}
    for kind, wid, content in new:
        if kind == "WORD":
            theirs.setdefault(wid, []).append(content)
    out, known = [], set()
    for kind, wid, content in old:
        if kind != "WORD":
            continue
        found = None if wid is None else theirs.get(wid)
        if found is None:
            out.append(("-", wid, ""))
            continue
        known.add(wid)
        for c in found:
            if c != content:
                out.append(("=", wid, c))
    out += [("+", wid, c) for wid, cs in theirs.items() if wid not in known for c in cs]
    return out


def _short(wid: str | None) -> str | None:
    return wid and wid[:ID_LEN]


def _between(lines: Lines, i: int) -> bool:
    """Whether line i ends a sentence between two words."""
    return 0 < i < len(lines) - 2 and lines[i][0] == "EOS" and lines[i - 1][0] == "WORD" and lines[i + 1][0] == "BOS" and lines[i + 2][0] == "WORD"


def document_boundaries(lines: Lines) -> set[tuple[str | None, str | None]]:
    """Ids before and after each sentence boundary between two words."""
    return {(_short(lines[i - 1][1]), _short(lines[i + 2][1])) for i, x in enumerate(lines) if x[0] == "EOS" and _between(lines, i)}


def document_sentences(old: Lines, new: Lines) -> Patches:
    """Boundaries gone (M, merge) and new (S, split)."""
    a, b = document_boundaries(old), document_boundaries(new)
    return [("M", *x) for x in a - b] + [("S", *x) for x in b - a]


def document_patches(old: Lines, new: Lines) -> Patches:
    return document_sentences(old, new) + document_words(old, new)


def _named(patches: Patches, op: str) -> dict:
    """wid and content of these patches, of one id the first. Those without an id name no word."""
    out: dict = {}
    for o, wid, content in patches:
        if o == op and wid is not None:
            out.setdefault(wid, content)
    return out


def document_merged(lines: Lines, patches: Patches) -> Lines:
    """lines without the boundaries that M patches name."""
    pairs = {(w, c) for op, w, c in patches if op == "M" and w is not None and c is not None}
    gone = {k for i, x in enumerate(lines) if pairs and x[0] == "EOS" and _between(lines, i) and (_short(lines[i - 1][1]), _short(lines[i + 2][1])) in pairs for k in (i, i + 1)}
    return [x for i, x in enumerate(lines) if i not in gone] if gone else lines


def document_replaced(lines: Lines, patches: Patches) -> Lines:
    """lines without the words that - patches name and with the contents of = patches."""
    gone, new = _named(patches, "-"), _named(patches, "=")
    got = []
    for x in lines:
        wid = x[1]
        if wid is None:
            got.append(x)
        elif wid not in gone:
            c = new.get(wid)
            got.append(x if c is None else (x[0], wid, c))
    return got


def document_split(lines: Lines, patches: Patches) -> Lines:
    """lines with </p> and <p> before the words that S patches name, if the named word is before."""
    pairs = {(w, c[:ID_LEN]) for op, w, c in patches if op == "S" and w is not None and c is not None}
    if not pairs:
        return lines
    out: Lines = []
    for i, x in enumerate(lines):
        if i and x[0] == "WORD" and lines[i - 1][0] == "WORD" and (_short(lines[i - 1][1]), _short(x[1])) in pairs:
            out += [("EOS", None, "</p>"), ("BOS", None, "<p>")]
        out.append(x)
    return out


def document_inserted(lines: Lines, patches: Patches) -> Lines:
    """lines with the words of + patches, each after the last word with a smaller id (at the head if there is none)."""
    words = sorted((wid, i) for i, (kind, wid, _) in enumerate(lines) if kind == "WORD" and wid is not None)
    ids = [w for w, _ in words]
    after: dict[int, Lines] = {}
    for wid, content in sorted(_named(patches, "+").items()):
        k = bisect_right(ids, wid)
        after.setdefault(words[k - 1][1] if k else -1, []).append(("WORD", wid, content))
    if not after:
        return lines
    out = after.get(-1, [])
    at = 0
    for i in sorted(i for i in after if i >= 0):
        out += lines[at : i + 1]
        out += after[i]
        at = i + 1
    return out + lines[at:]


def document_applied(lines: Lines, patches: Patches) -> Lines:
    """The document after merges, deletions and replacements, splits, and insertions."""
    out = document_replaced(document_merged(lines, patches), patches)
    return document_inserted(document_split(out, patches), patches)


def document_leftovers(lines: Lines, patches: Patches) -> Patches:
    """Delete and replace patches whose word does not exist."""
    known = {wid for kind, wid, _ in lines if kind == "WORD" and wid is not None}
    return [p for p in patches if p[0] in ("-", "=") and p[1] not in known]


def document_ordered(patches: Patches) -> Patches:
    """Sentence patches (M, S) before word patches, each kind in order of word ids; null first."""
    null_first = lambda x: (x is not None, x or "")
    return sorted(patches, key=lambda p: (p[0] not in ("M", "S"), null_first(p[1]), null_first(p[2]), p[0]))


def numbered(lines: Lines) -> Iterable[tuple]:
    return ((i, *x) for i, x in enumerate(lines, 1))


# ---- tables

def _together(lines: DataFrame, patches_or_new: DataFrame) -> DataFrame:
    """doc, a and b: what two tables hold of a document, in order of lines or as it comes."""

    def by_document(df: DataFrame, into: str) -> DataFrame:
        cols = ["line_no", "type", "wid", "content"] if "type" in df.columns else ["op", "wid", "content"]
        return df.groupBy("doc").agg(F.collect_list(F.struct(*cols)).alias(into))

    return by_document(lines, "a").join(by_document(patches_or_new, "b"), "doc", "full_outer")


def _tuples(rows: list[dict] | None) -> list[tuple]:
    if not rows:
        return []
    if "op" in rows[0]:
        return [(r["op"], r["wid"], r["content"]) for r in rows]
    return [(r["type"], r["wid"], r["content"]) for r in sorted(rows, key=lambda r: r["line_no"])]


def _each(a: DataFrame, b: DataFrame, fn: Callable, made: str) -> DataFrame:
    return rows_from(_together(a, b), ["doc"], ["a", "b"], lambda x, y: fn(_tuples(x), _tuples(y)), made)


def word_patches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Words changed (=), gone (-) and new (+)."""
    return _each(old, new, document_words, PATCH)


def boundary_patches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Boundaries gone (M, merge) and new (S, split)."""
    return _each(old, new, document_sentences, PATCH)


def make(old: DataFrame, new: DataFrame) -> DataFrame:
    """All patches from old to new, sentence patches first within each document."""
    return _each(old, new, document_patches, PATCH)


def parse(lines: DataFrame) -> DataFrame:
    """Patches from raw patch lines (doc, line_no, line); of conflicting ones the first. Others have `error`."""
    cols = F.split("line", "\t", 3)
    op = F.upper(F.get(cols, F.lit(0)))
    ok = ((F.size(cols) == 3) & op.isin("=", "+", "M", "S")) | ((F.size(cols) == 2) & (op == "-"))
    p = lines.where(F.col("line") != "").select("doc", "line_no", op.alias("op"), F.get(cols, F.lit(1)).alias("wid"), F.coalesce(F.get(cols, F.lit(2)), F.lit("")).alias("content"), ok.alias("ok"))
    key = F.when(F.col("op").isin("M", "S"), F.concat_ws("\t", "wid", "content")).otherwise(F.col("wid"))
    again = F.row_number().over(Window.partitionBy("doc", "ok", F.col("op").isin("M", "S"), key).orderBy("line_no")) > 1
    return p.withColumn("error", F.when(~F.col("ok"), "invalid").when(again, "conflict")).drop("ok")


def apply(lines: DataFrame, patches: DataFrame) -> DataFrame:
    """The corpus after merges, deletions and replacements, splits, and insertions."""
    return _each(lines, patches, lambda x, y: numbered(document_applied(x, y)), LINE)


def leftovers(lines: DataFrame, patches: DataFrame) -> DataFrame:
    """Delete and replace patches whose word does not exist."""
    return _each(lines, patches, document_leftovers, PATCH)


def ordered(patches: DataFrame) -> DataFrame:
    """Sentence patches (M, S) before word patches, each kind in order of word ids."""
    return patches.orderBy("doc", F.when(F.col("op").isin("M", "S"), 0).otherwise(1), "wid", "content", "op")


def write(patches: DataFrame, path: str) -> None:
    """A folder of patch lines for each document. What is under path is replaced, so that a document without patches keeps no stale ones."""
    line = F.when(F.col("op") == "-", F.concat_ws("\t", "op", "wid")).otherwise(F.concat_ws("\t", "op", "wid", "content"))
    kind = F.when(F.col("op").isin("M", "S"), 0).otherwise(1)
    rows = patches.select("doc", line.alias("value"), kind.alias("__kind"), "wid", "content").repartition("doc").sortWithinPartitions("doc", "__kind", "wid", "content")
    rows.select("doc", "value").write.mode("overwrite").partitionBy("doc").text(path)
