"""Alignment of a word's characters with the characters of its morphemes, and the output tags that follow from it.

align() takes what both sides have in common from the front and from the back; what is left in the middle goes through a table of rules, and last through a
dictionary of chunks. The DataFrame functions run it a batch at a time in the workers; only the distinct variants of restored characters are gathered, a table
that language bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hangul import decompose_str as jamo
from ..functions.tags import SENT_DELIM, SIMPLE, WORD_DELIM
from .batches import rows_from, with_columns
from .resources import entries
from .sizes import small
from .vocab import number_variants, top_examples

VERBS = {"VV", "VA", "VX"}
STEMS = VERBS | {"VCP", "VCN", "XSV", "XSA", "EP"}
ENDINGS = {"EC", "EP", "EF", "ETN", "ETM"}
#: Chunks of raw characters and their morpheme characters, with how many of these each raw character takes.
Chunks = dict[tuple[str, str], str]


class Unit(NamedTuple):
    """A character of a morpheme and its output tag."""

    chr: str
    tag: str

    @property
    def pos(self) -> str:
        return self.tag[2:]


class Misaligned(Exception):
    """The first argument is the kind: 0:N, N:0, M:N, phoneme, or end; the second, of M:N, the chunk that no rule knows."""


def show(units: Sequence[Unit]) -> str:
    return " ".join(f"{u.chr}/{u.tag}" for u in units)


def units_of(morphs: Sequence[tuple[str, str]]) -> list[Unit]:
    """B- marks a morpheme's first character only where the morpheme before has the same tag."""
    out, before = [], None
    for lex, tag in morphs:
        out += [Unit(c, ("B-" if i == 0 and tag == before else "I-") + tag) for i, c in enumerate(lex)]
        before = tag
    return out


def _takes(chr_: str, units: Sequence[Unit], at: int, step: int) -> int:
    """How many units from `at` in direction `step` sound like the raw character; 0 if none do."""
    one = units[at].chr
    if chr_ == one or jamo(chr_) == jamo(one):
        return 1
    if 0 <= at + step < len(units):
        pair = one + units[at + step].chr if step > 0 else units[at + step].chr + one
        if jamo(chr_) == jamo(pair):
            return 2
    if chr_ == "㈜" and step < 0 and at >= 2 and (units[at - 2].chr, units[at - 1].chr, one) == ("(", "주", ")"):
        return 3
    return 0


def common(raw: str, units: Sequence[Unit], step: int) -> tuple[int, int]:
    """Characters and units that agree from the front (step 1) or the back (-1)."""
    n = used = 0
    for chr_ in raw[::step]:
        at = used if step > 0 else len(units) - 1 - used
        if not 0 <= at < len(units):
            if step > 0:
                raise Misaligned("end")
            break
        took = _takes(chr_, units, at, step)
        if not took:
            break
        n, used = n + 1, used + took
    return n, used


def by_sound(raw: str, units: Sequence[Unit]) -> list[list[Unit]]:
    """One or two units for each character, three for the sign of a company; the second of two must be a jamo as it stands."""
    out, at = [], 0
    for chr_ in raw:
        if at >= len(units):
            raise Misaligned("end")
        one, rest = units[at].chr, [u.chr for u in units[at + 1 : at + 3]]
        if chr_ == one or jamo(chr_) == jamo(one):
            n = 1
        elif rest and jamo(chr_) == jamo(one) + rest[0]:
            n = 2
        elif chr_ == "㈜" and [one, *rest] == ["(", "주", ")"]:
            n = 3
        else:
            raise Misaligned("phoneme")
        out.append(list(units[at : at + n]))
        at += n
    return out


def inflected(a: Unit, b: Unit) -> bool:
    return a.pos in STEMS and b.pos in ENDINGS


def ends_alike(raw: str, units: Sequence[Unit]) -> bool:
    a, b = jamo(raw), jamo("".join(u.chr for u in units))
    return a[0] == b[0] and a[-1] == b[-1]


def sounds_shared(raw: str, units: Sequence[Unit]) -> bool:
    """Of one character the first two sounds, of several each first sound."""
    if len(raw) == 1:
        return jamo(raw)[:2] == jamo(units[0].chr)[:2]
    return all(jamo(c)[0] in jamo(u.chr) for c, u in zip(raw, units, strict=True))


#: Raw characters, units, condition, and how many units each raw character takes; the first that holds is used.
Rule = tuple[int, int, Callable[[str, Sequence[Unit]], bool], tuple[int, ...]]
RULES: list[Rule] = [
    (1, 2, lambda _, u: inflected(u[0], u[1]), (2,)),
    (2, 4, lambda _, u: inflected(u[0], u[1]) and inflected(u[2], u[3]), (2, 2)),
    (1, 1, lambda _, u: u[0].pos in VERBS, (1,)),
    (2, 2, ends_alike, (1, 1)),
    (2, 3, lambda _, u: u[0].pos == u[1].pos and inflected(u[1], u[2]), (2, 1)),
]


def cut(units: Sequence[Unit], sizes: Sequence[int]) -> list[list[Unit]]:
    out, at = [], 0
    for n in sizes:
        out.append(list(units[at : at + n]))
        at += n
    return out


def middle(raw: str, units: list[Unit], chunks: Chunks) -> list[list[Unit]]:
    for n, m, holds, sizes in RULES:
        if (len(raw), len(units)) == (n, m) and holds(raw, units):
            return cut(units, sizes)
    if len(raw) == len(units) and sounds_shared(raw, units):
        return [[u] for u in units]
    if sizes := chunks.get((raw, show(units))):
        return cut(units, list(map(int, sizes)))
    raise Misaligned("M:N", f"{raw} => {show(units)}")


def hand_over(head: list[list[Unit]], units: list[Unit], tail: list[list[Unit]]) -> None:
    """Gives the last unit of the middle to the tail where it is a copula before an ending, or the auxiliary of 야 하겠."""
    if not (units and tail):
        return
    last, first = units[-1], tail[0][0]
    before = units[-2] if len(units) > 1 else head[-1][-1] if head else None
    copula = last == Unit("이", "I-VCP") and first.tag in {"I-EC", "I-EF", "I-EP", "I-ETM", "I-ETN"}
    auxiliary = last == Unit("하", "I-VX") and first == Unit("겠", "I-EP") and Unit("야", "I-EC") in (before, head[-1][-1] if head else None)
    if copula or auxiliary:
        tail[0].insert(0, units.pop())


def attach(head: list[list[Unit]], unit: Unit, tail: list[list[Unit]]) -> None:
    """A single unit without a raw character of its own goes to the neighbour it belongs to."""
    if tail and (not head or unit.tag.startswith("B-") or tail[0][0].pos == unit.pos or head[-1][-1].pos != unit.pos):
        tail[0].insert(0, unit)
    elif head:
        head[-1].append(unit)
    else:
        raise Misaligned("0:N")


def align(raw: str, morphs: Sequence[tuple[str, str]], chunks: Chunks | None = None) -> list[list[Unit]]:
    """The units of each raw character; raises Misaligned."""
    units = units_of(morphs)
    flat = "".join(u.chr for u in units)
    if raw == flat:
        return [[u] for u in units]
    if jamo(raw) == jamo(flat):
        return by_sound(raw, units)
    n, used = common(raw, units, 1)
    m, last = common(raw[n:], units[used:], -1)
    end, until = len(raw) - m, len(units) - last
    head, inner, tail = by_sound(raw[:n], units[:used]), units[used:until], by_sound(raw[end:], units[until:])
    hand_over(head, inner, tail)
    if not raw[n:end]:
        if len(inner) > 1:
            raise Misaligned("0:N")
        if inner:
            attach(head, inner[0], tail)
        return head + tail
    if not inner:
        raise Misaligned("N:0")
    return head + middle(raw[n:end], inner, chunks or {}) + tail


def char_tags(raw: str, aligned: list[list[Unit]]) -> list[tuple[str, str | None]]:
    """For each character its tag, and what it restores to if that is not itself."""
    return [(us[0].tag, None) if len(us) == 1 and us[0].chr == c else (":".join(u.tag for u in us), show(us)) for c, us in zip(raw, aligned, strict=True)]


def _one(raw: str | None, morphs, chunks: Chunks) -> tuple[list[dict] | None, str | None, str | None]:
    if raw is None or morphs is None:
        return None, "null", None
    try:
        found = char_tags(raw, align(raw, [(m["lex"], m["tag"]) for m in morphs], chunks))
    except Misaligned as e:
        return None, e.args[0], e.args[1] if len(e.args) > 1 else None
    except (ValueError, IndexError):
        return None, "end", None
    return [{"tag": t, "vals": v} for t, v in found], None, None


def align_words(words: DataFrame, raw: str = "raw", morphs: str = "morph_list", chunks: Chunks | None = None) -> DataFrame:
    """words with chars, array<struct<tag, vals>> (vals null where a character is itself), error, the kind of what could not be aligned, and its chunk."""
    known = chunks or {}

    def fn(cols: list[list]) -> list[list]:
        got = [_one(r, m, known) for r, m in zip(*cols, strict=True)]
        return [[x[k] for x in got] for k in range(3)]

    return with_columns(words, [raw, morphs], fn, "chars array<struct<tag:string,vals:string>>, error string, chunk string")


def unmapped(aligned: DataFrame, raw: str = "raw", most: int = 10) -> DataFrame:
    """The chunks that no rule knows, with their totals and their most frequent words; order by total to see what a dictionary should have first."""
    return top_examples(aligned.where("chunk is not null"), ["chunk"], raw, most)


def variants(aligned: DataFrame, order: list[str], raw: str = "raw", known: dict[tuple[str, str], dict[int, str]] | None = None) -> DataFrame:
    """chr, tag, vals, num and first_pos: what characters restore to, numbered for each (chr, tag) by first occurrence, after the known ones."""
    each = aligned.where("error is null").select(F.struct(*order).alias("__at"), F.posexplode(F.arrays_zip(F.split(raw, "").alias("chr"), "chars")).alias("i", "c"))
    pairs = each.where("c.chars.vals is not null").select("c.chr", "c.chars.tag", "c.chars.vals", F.struct("__at", "i").alias("pos"))
    if not known:
        return number_variants(pairs)
    rows = [(c, t, v, n) for (c, t), vals in known.items() for n, v in vals.items()]
    old = pairs.sparkSession.createDataFrame(rows, "chr string, tag string, vals string, num int")
    new = number_variants(pairs.join(small(old), ["chr", "tag", "vals"], "left_anti")) if rows else number_variants(pairs)
    most = old.groupBy("chr", "tag").agg((F.max("num") + 1).alias("__base"))
    return new.join(small(most), ["chr", "tag"], "left").withColumn("num", F.col("num") + F.coalesce("__base", F.lit(0))).drop("__base")


def tag_words(aligned: DataFrame, numbered: DataFrame, raw: str = "raw") -> DataFrame:
    """aligned with tags: simple output tags, and composites with the number of their variant, such as I-VV:I-EP:0."""
    number = {(r["chr"], r["tag"], r["vals"]): r["num"] for r in entries(numbered.select("chr", "tag", "vals", "num"))}

    def fn(cols: list[list]) -> list[list]:
        return [[None if cs is None else [c["tag"] if c["vals"] is None else f"{c['tag']}:{number[x, c['tag'], c['vals']]}" for x, c in zip(r, cs, strict=True)] for r, cs in zip(*cols, strict=True)]]

    return with_columns(aligned, [raw, "chars"], fn, "tags array<string>")


def tag_numbers(composites: list[str]) -> dict[str, int]:
    """Numbers of output tags: the simple ones, then these composites in order."""
    return {t: i for i, t in enumerate([*SIMPLE, *composites], 1)}


#: A sentence's words: word_idx, raw, and morphemes as lex and tag.
Words = list[tuple[int, str | None, Sequence[tuple[str, str]] | None]]


def sentence_chars(words: Words, chunks: Chunks, whole: bool = True) -> list[tuple[int, str, list[tuple[str, str | None]]]]:
    """word_idx, raw and char_tags of the words that can be aligned; whole: of none if one of them can't."""
    out = []
    for at, raw, morphs in words:
        try:
            if raw is None or morphs is None:
                raise Misaligned("null")
            out.append((at, raw, char_tags(raw, align(raw, morphs, chunks))))
        except (Misaligned, ValueError, IndexError):
            if whole:
                return []
    return out


def _read(words: list[dict]) -> Words:
    return [(w["word_idx"], w["raw"], None if w["morph_list"] is None else [(m["lex"], m["tag"]) for m in w["morph_list"]]) for w in words]


def sentence_variants(sents: DataFrame, sentence: list[str], words: str = "words", read: Callable[..., Words] = _read, chunks: Chunks | None = None, whole: bool = True) -> DataFrame:
    """variants of a table of sentences, with the first word that each occurs in (example). read: makes the words of what the column `words` holds. Only composites leave the workers."""
    known = chunks or {}

    def fn(own):
        return ((at, raw, i, c, tag, vals) for at, raw, chars in sentence_chars(read(own), known, whole) for i, (c, (tag, vals)) in enumerate(zip(raw, chars, strict=True)) if vals is not None)

    found = rows_from(sents, sentence, [words], lambda x: () if x is None else fn(x), "word_idx int, raw string, i int, chr string, tag string, vals string")
    return number_variants(found.select("chr", "tag", "vals", "raw", F.struct(F.struct(*sentence, "word_idx").alias("__at"), "i").alias("pos")), "raw")


def tag_sentences(sents: DataFrame, sentence: list[str], words: str = "words", read: Callable[..., Words] = _read, chunks: Chunks | None = None) -> tuple[DataFrame, DataFrame]:
    """Training words (sentence, word_idx, raw, tags) of the sentences that can be aligned whole, and the restore table that is gathered from them. Sentences stay where they are."""
    known, numbered = chunks or {}, sentence_variants(sents, sentence, words, read, chunks)
    number = {(r["chr"], r["tag"], r["vals"]): r["num"] for r in entries(numbered.select("chr", "tag", "vals", "num"))}

    def fn(own):
        for at, raw, chars in sentence_chars(read(own), known):
            yield at, raw, [tag if vals is None else f"{tag}:{number[c, tag, vals]}" for c, (tag, vals) in zip(raw, chars, strict=True)]

    return rows_from(sents, sentence, [words], lambda x: () if x is None else fn(x), "word_idx int, raw string, tags array<string>"), numbered


def tag_corpus(words: DataFrame, sentence: list[str], chunks: Chunks | None = None) -> tuple[DataFrame, DataFrame]:
    """tag_sentences of a table of words (word_idx, raw, morph_list)."""
    return tag_sentences(words.groupBy(*sentence).agg(F.collect_list(F.struct("word_idx", "raw", "morph_list")).alias("words")), sentence, chunks=chunks)


def compile_preanal(words: DataFrame, known: dict[tuple[str, str], dict[int, str]], tags: dict[str, int], chunks: Chunks | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """From word, is_pfx, line_no, morph_list: the dictionary (key, is_pfx, tag_nums, error), the variants it adds to the known ones, and all tag numbers."""
    aligned = align_words(words, "word", "morph_list", chunks)
    added = variants(aligned, ["line_no"], "word", known or {("", ""): {}})
    rows = [(c, t, v, n) for (c, t), vals in known.items() for n, v in vals.items()]
    every = added.select("chr", "tag", "vals", "num").union(words.sparkSession.createDataFrame(rows, "chr string, tag string, vals string, num int"))
    tagged = tag_words(aligned, every, "word")
    seen = {r["t"]: r["at"] for r in entries(tagged.select("line_no", F.posexplode_outer("tags").alias("i", "t")).where("t is not null").groupBy("t").agg(F.min(F.struct("line_no", "i")).alias("at")))}
    numbers = dict(tags)
    for t in sorted((t for t in seen if t not in tags), key=seen.get):
        numbers[t] = len(numbers) + 1
    out = with_columns(tagged, ["tags"], lambda cols: [[None if ts is None else [numbers[t] for t in ts] for ts in cols[0]]], "tag_nums array<int>")
    return out.select(F.col("word").alias("key"), "is_pfx", "tag_nums", "error"), added, numbers


def split_runs(items: list[str], delim: str) -> list[list[str]]:
    """Runs between delimiters; neighbouring delimiters count as one, and one at the begin leaves an empty run."""
    out: list[list[str]] = [[]] if items else []
    closed = False
    for x in items:
        if x == delim:
            closed = True
            continue
        if closed:
            out.append([])
            closed = False
        out[-1].append(x)
    return out


def patch_side(raw: str, side: str, known: dict[tuple[str, str], dict[int, str]], tags: dict[str, int], chunks: Chunks | None = None) -> list[int] | None:
    """Tag numbers, with delimiters, of one side of an error patch; None if it can't be aligned with what is known."""
    parts, lead, tail = side.split(" + "), [], []
    marks = {"_": WORD_DELIM, "|": SENT_DELIM}
    if parts[0] in marks:
        lead, parts = [marks[parts[0]]], parts[1:]
    if parts and parts[-1] in marks:
        tail, parts = [marks[parts[-1]]], parts[:-1]
    out: list[int] = []
    for k, (word, morphs) in enumerate(zip(raw.split(), split_runs(parts, "_"), strict=False)):
        try:
            found = char_tags(word, align(word, [tuple(m.rsplit("/", 1)) for m in morphs], chunks))
        except (Misaligned, ValueError, IndexError):
            return None
        nums = []
        for c, (tag, vals) in zip(word, found, strict=True):
            if vals is not None:
                n = next((n for n, v in known.get((c, tag), {}).items() if v == vals), None)
                tag = f"{tag}:{n}"
            nums.append(tags.get(tag))
        if None in nums:
            return None
        out += [WORD_DELIM] * (k > 0) + nums
    return lead + out + tail


def compile_errpatch(lines: DataFrame, known: dict[tuple[str, str], dict[int, str]], tags: dict[str, int], chunks: Chunks | None = None) -> DataFrame:
    """From raw, wrong and right (text): left (packed characters), right (tag numbers), and error for what can't be aligned or differs in length."""
    from ..functions.tags import CHAR_TAG

    def one(raw: str, wrong: str, right: str):
        a, b = (patch_side(raw, x, known, tags, chunks) for x in (wrong, right))
        if a is None or b is None:
            return None, None, "align"
        if len(a) != len(b):
            return None, None, "lengths"
        chars = iter(raw.replace(" ", "").replace("\t", ""))
        return [t if t < 0 else ord(next(chars)) * CHAR_TAG + t for t in a], b, None

    def fn(cols: list[list]) -> list[list]:
        return [list(x) for x in zip(*[one(*r) for r in zip(*cols, strict=True)], strict=True)] if cols[0] else [[], [], []]

    return with_columns(lines, ["raw", "wrong", "right"], fn, "left array<bigint>, `right` array<int>, error string")
