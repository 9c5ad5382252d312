"""Hangul syllables and jamo. Python twins of the column functions serve the batch operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MIDDLE = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
LAST = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def _run(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


#: Conjoining and halfwidth jamo, and the compatibility jamo that stand for them.
OTHER_JAMO = _run(0x1100, 0x1112) + _run(0x1161, 0x1175) + _run(0x11A8, 0x11C2) + _run(0xFFA1, 0xFFBE) + _run(0xFFC2, 0xFFC7) + _run(0xFFCA, 0xFFCF) + _run(0xFFD2, 0xFFD7) + _run(0xFFDA, 0xFFDC)
COMPAT_JAMO = FIRST + MIDDLE + LAST + _run(0x3131, 0x314E) + MIDDLE
ARCHAIC, ARCHAIC_COMPAT = "ᆞᄝ", "ㆍㅱ"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYLLABLES = "가나다라마바사아자차카타파하거너더러머버서어저처커터"


def decompose(text: Column) -> Column:
    """Each syllable as its two or three compatibility jamo, other characters as they are."""

    def one(c: Column) -> Column:
        at = F.ascii(c) - 0xAC00
        last = at % 28
        jamo = F.concat(F.substring(F.lit(FIRST), F.floor(at / 588).cast("int") + 1, F.lit(1)), F.substring(F.lit(MIDDLE), F.floor(at % 588 / 28).cast("int") + 1, F.lit(1)), F.when(last > 0, F.substring(F.lit(LAST), last, F.lit(1))).otherwise(""))
        return F.when((c >= "가") & (c <= "힣"), jamo).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def to_compat(text: Column) -> Column:
    """Conjoining and halfwidth jamo as compatibility jamo."""
    return F.translate(text, OTHER_JAMO, COMPAT_JAMO)


def fix_archaic(text: Column) -> Column:
    return F.translate(text, ARCHAIC, ARCHAIC_COMPAT)


def from_latin(text: Column) -> Column:
    """A fixed syllable for each Latin letter: Hangul text made of any other, for trials."""
    return F.translate(F.lower(text), LETTERS, SYLLABLES)


@functools.lru_cache(1 << 15)
def _jamo(chr_: str) -> str:
    at = ord(chr_) - 0xAC00
    if not 0 <= at < 11172:
        return chr_
    return FIRST[at // 588] + MIDDLE[at % 588 // 28] + (LAST[at % 28 - 1] if at % 28 else "")


def decompose_str(text: str) -> str:
    return "".join(map(_jamo, text))
