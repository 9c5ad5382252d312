"""Numpy views of many texts at once: code points, character classes, words and their 64-bit hashes.

Texts lie side by side in one array of code points, each followed by a newline, so that no word or class run crosses
from one text into the next. Everything per character is a table lookup or a prefix sum.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, SPACE, LOWER, UPPER, LETTER, DIGIT, PUNCT = range(7)
_COMMON = set(".,;:!?'\"()-–—’‘“”«»¿¡…/")
_P = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        cat = unicodedata.category(chr(cp))
        if cat == "Ll":
            out[cp] = LOWER
        elif cat in ("Lu", "Lt"):
            out[cp] = UPPER
        elif cat[0] in "LM":
            out[cp] = LETTER
        elif cat[0] == "N":
            out[cp] = DIGIT
        elif cat[0] == "Z":
            out[cp] = SPACE
    for ch in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85":
        out[ord(ch)] = SPACE
    for ch in _COMMON:
        out[ord(ch)] = PUNCT
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]))
        for k, p in enumerate((_P, np.uint64(pow(int(_P), -1, 1 << 64)))):
            a = np.full(m, p, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


class Texts:
    """cp: code points; start, end: of each text in cp."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        self.n = len(texts)
        length = np.fromiter(map(len, texts), np.int64, self.n)
        self.cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        self.kind = classes()[self.cp]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many characters of each text are flagged."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.end] - total[self.start]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each maximal run of flagged characters; none holds the newline after a text."""
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters and digits."""
        return self.runs((self.kind >= LOWER) & (self.kind <= DIGIT))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of anything but white space."""
        return self.runs(self.kind != SPACE)

    def text_of(self, begin: np.ndarray) -> np.ndarray:
        """The number of the text that holds each position."""
        return np.searchsorted(self.end, begin, side="left")

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the code points of each span."""
        p, inv = powers(len(self.cp) + 1)
        total = np.zeros(len(self.cp) + 1, np.uint64)
        np.cumsum(mix(self.cp + np.uint64(0x51ED27)) * p[: len(self.cp)], out=total[1:])
        return mix((total[end] - total[begin]) * inv[begin] + (end - begin).astype(np.uint64))


def group_counts(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, key) with their counts, ordered by group; group must be ascending and below 2**24.

    Keys count as equal when their upper 40 bits are, so that one sort of 64-bit integers does.
    """
    packed = (group.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
    packed.sort()
    first = np.ones(len(packed), bool)
    first[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(packed)))
    packed = packed[at]
    return (packed >> np.uint64(40)).astype(np.int64), packed << np.uint64(24), count
