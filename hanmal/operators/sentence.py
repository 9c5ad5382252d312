"""The analyzer's stages on one sentence: its words and the output tags of their characters. Nothing here needs another row."""

from __future__ import annotations

from ..functions.scan import SPACE_CODES
from ..functions.tags import CHAR_TAG, N_TAGS, SENT_DELIM, TAGS, WORD_DELIM
from .resources import Dictionaries, Restored

_SPACES = "".join(map(chr, SPACE_CODES))
Words, Tags = list[str], list[list[int]]
Morph = tuple[str, str, int, int]


def tokenize(text: str) -> list[tuple[str, int]]:
    """The words of text up to its first NUL, and where they begin."""
    text, out, begin = text.partition("\0")[0], [], -1
    for i, c in enumerate(text):
        if c in _SPACES:
            if begin >= 0:
                out.append((text[begin:i], begin))
            begin = -1
        elif begin < 0:
            begin = i
    if begin >= 0:
        out.append((text[begin:], begin))
    return out


def preanal(word: str, d: Dictionaries, longest: int) -> list[int]:
    """Tags of the longest entry that is the word or a prefix of it, 0 for the other characters."""
    if word in d.exact:
        found = d.exact[word]
        longer = d.prefix.get(word)
        return longer if longer is not None and len(longer) > len(found) else found
    for n in range(min(len(word), longest), 0, -1):
        if (found := d.prefix.get(word[:n])) is not None:
            return found + [0] * (len(word) - n)
    return [0] * len(word)


def first_tag(tag: int, d: Dictionaries) -> int:
    return d.firsts.get(tag, tag)


def revise(words: Words, tags: Tags, d: Dictionaries) -> Tags:
    """A composite tag that the dictionary lacks for its character becomes its first tag; then a B- tag at a word's begin, or after another category, becomes I-. 0 stays 0."""
    out = []
    for word, own in zip(words, tags, strict=True):
        before, got = 0, []
        for chr_, tag in zip(word, own, strict=True):
            if tag > 2 * N_TAGS and (chr_, tag) not in d.restored:
                tag = first_tag(tag, d)
            if 0 < tag <= N_TAGS and before != tag:
                tag += N_TAGS
            got.append(tag)
            before = 0 if tag <= 0 else (tag - 1) % N_TAGS + 1 if tag <= 2 * N_TAGS else d.restored[chr_, tag][-1][1] if (chr_, tag) in d.restored else (first_tag(tag, d) - 1) % N_TAGS + 1
        out.append(got)
    return out


def restore(chr_: str, tag: int, d: Dictionaries, use_dic: bool = True) -> Restored:
    """The characters that chr_ stands for, with simple tags and B (0) or I (1); a composite the dictionary lacks, or all with it off, get their first tag."""
    if tag > 2 * N_TAGS:
        if use_dic and (found := d.restored.get((chr_, tag))) is not None:
            return found
        tag = first_tag(tag, d)
    return [(chr_, (tag - 1) % N_TAGS + 1, int(tag > N_TAGS))]


def morphs(word: str, tags: list[int], d: Dictionaries, use_dic: bool = True) -> list[Morph]:
    """lex, tag, first and last source character of each morpheme."""
    out: list[Morph] = []
    lex, tag, first, last = "", 0, -1, -1
    for i, (chr_, t) in enumerate(zip(word, tags, strict=True)):
        for c, num, inside in restore(chr_, t, d, use_dic):
            if inside and num == tag:
                lex, last = lex + c, i
            else:
                if lex:
                    out.append((lex, TAGS[tag - 1], first, last))
                lex, tag, first, last = c, num, i, i
    if lex:
        out.append((lex, TAGS[tag - 1], first, last))
    return out


def with_delimiters(tags: Tags) -> list[int]:
    """The layout before error patching: -2, the words' tags with -1 between, -2; a single -2 without words."""
    out = [SENT_DELIM]
    for i, own in enumerate(tags):
        out += [WORD_DELIM] * (i > 0) + own
    return out + [SENT_DELIM] * bool(tags)


def packed(words: Words, tags: Tags) -> list[int]:
    """Characters and tags as integers, with delimiters."""
    out = [SENT_DELIM]
    for i, (word, own) in enumerate(zip(words, tags, strict=True)):
        out += [WORD_DELIM] * (i > 0) + [ord(c) * CHAR_TAG + t for c, t in zip(word, own, strict=True)]
    return out + [SENT_DELIM]


class Patcher:
    """Error patches by their first integer and length: leftmost-longest, without overlaps."""

    def __init__(self, patches: dict[tuple[int, ...], list[int]]):
        self.patches = patches
        lengths: dict[int, set[int]] = {}
        for left in patches:
            lengths.setdefault(left[0], set()).add(len(left))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def matches(self, mix: list[int]) -> list[tuple[int, list[int]]]:
        """Place and right side of each match that applies."""
        out, i = [], 0
        while i < len(mix):
            for n in self.lengths.get(mix[i], ()):
                if i + n <= len(mix) and (right := self.patches.get(tuple(mix[i : i + n]))) is not None:
                    out.append((i, right))
                    i += n - 1
                    break
            i += 1
        return out

    def patch(self, mix: list[int], tags: list[int]) -> list[int]:
        """tags (with delimiters) after all matches; delimiters stay."""
        out = list(tags)
        for at, right in self.matches(mix):
            for k, t in enumerate(right):
                if out[at + k] >= 0:
                    out[at + k] = t
        return out

    def apply(self, words: Words, tags: Tags) -> Tags:
        if not self.patches or not words:
            return tags
        flat = self.patch(packed(words, tags), with_delimiters(tags))
        out, at = [], 1
        for own in tags:
            out.append(flat[at : at + len(own)])
            at += len(own) + 1
        return out
