"""The analyzer's deterministic stages over a table of sentences: one row has words (array of strings) and tags (an array of output tags for each word).

Every stage is a column expression or an Arrow pass over its own rows; nothing is shuffled, so streams can use them too. Dictionaries
go to the workers (resources.Dictionaries), behind a check of their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T
from . import sentence as S
from .batches import with_columns
from .resources import Dictionaries

#: Restored characters that a worker keeps.
MOST_KNOWN = 1 << 20
RESTORED = "struct<chr:string,tag:int,bi:int>"
MORPH = "struct<lex:string,tag:string,first_char:int,last_char:int>"


def _each(sents: DataFrame, fn, added: str, *inputs: str) -> DataFrame:
    """Columns computed from each row's words, tags and further inputs."""

    def run(cols: list[list]) -> list[list]:
        rows = [fn(*r) for r in zip(*cols, strict=True)]
        return [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in range(added.count("`") // 2)]

    return with_columns(sents, ["words", "tags", *inputs], run, added)


def apply_preanal(sents: DataFrame, d: Dictionaries) -> DataFrame:
    """sents (words) with tags from the pre-analysis dictionary, 0 where it says nothing."""
    longest = d.longest()
    return with_columns(sents, ["words"], lambda cols: [[[S.preanal(w, d, longest) for w in ws] for ws in cols[0]]], "`tags` array<array<int>>")


def revise_tags(sents: DataFrame, d: Dictionaries) -> DataFrame:
    """A composite that d lacks for its character becomes its first tag; then a B- tag at a word's begin, or after another category, becomes I-."""
    return _each(sents, lambda w, t: (S.revise(w, t, d),), "`tags` array<array<int>>")


def apply_errpatch(sents: DataFrame, d: Dictionaries) -> DataFrame:
    """Leftmost-longest, non-overlapping error patches over characters, tags and delimiters."""
    patcher = S.Patcher(d.patches)
    return _each(sents, lambda w, t: (patcher.apply(w, t),), "`tags` array<array<int>>")


def restore(sents: DataFrame, d: Dictionaries, use_dic: bool = True) -> DataFrame:
    """restored: for each character the characters it stands for; missing: whether it is a composite that d lacks."""

    def one(chr_: str, tag: int) -> tuple[list[dict], bool]:
        return [{"chr": c, "tag": t, "bi": b} for c, t, b in S.restore(chr_, tag, d, use_dic)], tag > 2 * T.N_TAGS and (chr_, tag) not in d.restored

    known: dict[tuple[str, int], tuple[list[dict], bool]] = {}

    def fn(words, tags):
        got, missing = [], []
        for word, own in zip(words, tags, strict=True):
            pairs = list(zip(word, own, strict=True))
            for x in pairs:
                if x not in known:
                    known[x] = one(*x)
            got.append([known[x][0] for x in pairs])
            missing.append([known[x][1] for x in pairs])
        if len(known) > MOST_KNOWN:
            known.clear()
        return got, missing

    return _each(sents, fn, f"`restored` array<array<array<{RESTORED}>>>, `missing` array<array<boolean>>")


def restored_alike(sents: DataFrame, d: Dictionaries) -> DataFrame:
    """same: of each word whether it restores to the same characters and tags with the dictionary and without."""
    plain = lambda c, t, on: [r[:2] for r in S.restore(c, t, d, on)]
    known: dict[tuple[str, int], bool] = {}

    def alike(word: str, own: list[int]) -> bool:
        every = True
        for x in zip(word, own, strict=True):
            if x not in known:
                known[x] = plain(*x, True) == plain(*x, False)
            every = every and known[x]
        return every or [r for x in zip(word, own, strict=True) for r in plain(*x, True)] == [r for x in zip(word, own, strict=True) for r in plain(*x, False)]

    def fn(words, tags):
        if len(known) > MOST_KNOWN:
            known.clear()
        return ([alike(w, t) for w, t in zip(words, tags, strict=True)],)

    return _each(sents, fn, "`same` array<boolean>")


def make_morphs(sents: DataFrame, d: Dictionaries, use_dic: bool = True) -> DataFrame:
    """morphs: of each word its morphemes, with the first and last character they come from."""
    row = lambda m: {"lex": m[0], "tag": m[1], "first_char": m[2], "last_char": m[3]}
    return _each(sents, lambda w, t: ([[row(m) for m in S.morphs(x, y, d, use_dic)] for x, y in zip(w, t, strict=True)],), f"`morphs` array<array<{MORPH}>>")


def sentence_tags(words: Column) -> Column:
    """Tags of a sentence in the layout before error patching: -2, the tags of each word with -1 between words, -2.

    words: array of tag arrays. A sentence without words is a single -2.
    """
    end = F.array(F.lit(T.SENT_DELIM))
    body = F.flatten(F.transform(words, lambda w, i: F.when(i > 0, F.concat(F.array(F.lit(T.WORD_DELIM)), w.cast("array<int>"))).otherwise(w.cast("array<int>"))))
    return F.when(F.size(words) == 0, end).otherwise(F.concat(end, body, end))


def contexts(sents: DataFrame, ids: str, window: int, into: str = "contexts") -> DataFrame:
    """sents with `into`: for each id of each word (arrays of arrays) those of `window` characters on each side, across the sentence's words, 0 beyond it."""

    def one(words: list[list[int]] | None):
        if words is None:
            return None
        padded = [0] * window + [i for w in words for i in w] + [0] * window
        out, at = [], 0
        for w in words:
            out.append([padded[i : i + 2 * window + 1] for i in range(at, at + len(w))])
            at += len(w)
        return out

    return with_columns(sents, [ids], lambda cols: [[one(x) for x in cols[0]]], f"`{into}` array<array<array<int>>>")


def bound_masks(char_idx: Column, word_len: Column, window: int) -> tuple[Column, Column]:
    """Places in the context at which the word's begin and end are marked; -1 if outside."""
    left, right = window - char_idx, window + word_len - char_idx - 1
    return F.when(left >= 0, left).otherwise(-1), F.when(right <= 2 * window, right).otherwise(-1)


def dropped(keys: list[Column], rate: float, seed: int = 0) -> Column:
    """Whether a mask is zeroed: a share `rate` of keys, chosen by plain arithmetic on them, so that both runs of a task agree."""
    from .split import uniform

    return uniform(*keys, seed=seed) < rate


def positional_encoding(position: Column, dim: Column, length: int, width: int) -> Column:
    """1 - p/L - (i/D)(1 - 2p/L) for position p and dimension i, both from 1."""
    p = position / length
    return 1 - p - dim / width * (1 - 2 * p)


def char_rows(sents: DataFrame, keep: list[str], *values: str) -> DataFrame:
    """One row for each character: word_idx, word, char_idx, chr and the values (arrays of arrays beside words)."""
    w = sents.select(*keep, F.posexplode(F.arrays_zip("words", *values)).alias("word_idx", "w"))
    w = w.select(*keep, "word_idx", F.col("w.words").alias("word"), *[F.col(f"w.{v}").alias(v) for v in values])
    c = w.select(*keep, "word_idx", "word", F.posexplode(F.arrays_zip(F.split("word", "").alias("chr"), *values)).alias("char_idx", "c"))
    return c.select(*keep, "word_idx", "word", "char_idx", "c.*")


def morph_rows(sents: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each morpheme: word_idx, word, morph_idx and its fields."""
    w = sents.select(*keep, F.posexplode(F.arrays_zip("words", "morphs")).alias("word_idx", "w"))
    m = w.select(*keep, "word_idx", F.col("w.words").alias("word"), F.posexplode("w.morphs").alias("morph_idx", "m"))
    return m.select(*keep, "word_idx", "word", "morph_idx", "m.*")
