"""Exact token counts of whole texts under a byte-level BPE vocabulary.

A text's pre-tokens never cross from one word into the next, so the count of a text is the sum over its words, and each
worker remembers the counts of many words. Texts with runs of white space are encoded as they are.
"""

from __future__ import annotations

import base64
import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, map_rows, require

#: A public vocabulary in tiktoken's format; executors read it from this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers, the first it meets; the others of a text are encoded together.
MOST_WORDS = 100_000
_OTHER_SPACE = re.compile(r"[^\S \n]")


def single_spaced(text: str) -> bool:
    """Whether white space is single spaces and newlines between words."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return _OTHER_SPACE.search(text) is None


@functools.lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Counts:
    """Tokens of words that stand after `before`, most of them from memory."""

    def __init__(self, path: str, before: str):
        self.encode, self.before, self.known = encoding(path).encode_ordinary, before, {}

    def __call__(self, words: list[str]) -> int:
        found = list(map(self.known.get, words))
        if None not in found:
            return sum(found)
        new = [w for w, n in zip(words, found, strict=True) if n is None]
        total = sum(filter(None, found))
        if len(self.known) < MOST_WORDS:
            for w in new:
                self.known[w] = n = len(self.encode(self.before + w))
                total += n
            return total
        if self.before:
            return total + len(self.encode(self.before + self.before.join(new)))
        return total + len(self.encode("\n".join(new))) - len(new) + 1


@functools.lru_cache(2)
def _caches(path: str) -> tuple[_Counts, _Counts]:
    return _Counts(path, ""), _Counts(path, " ")


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    if not text:
        return 0
    if not single_spaced(text):
        return len(encoding(path).encode_ordinary(text))
    head, later = _caches(path)
    first, rest = [], []
    for line in text.split("\n"):
        words = line.split(" ")
        first.append(words[0])
        rest += words[1:]
    return len(first) - 1 + head(first) + later(rest)


def with_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, fp and n_tokens of each row; a null or empty text has none."""
    require(docs, "doc_id", "text")
    fn = lambda cols: {"doc_id": cols[0], "fp": cols[1], "n_tokens": [count_tokens(x, path) for x in cols[2]]}
    return map_rows(docs, [F.col("doc_id").cast("long"), fingerprint(), "text"], fn, "doc_id long, fp long, n_tokens long")
