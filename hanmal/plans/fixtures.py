"""Small hand-made dictionaries, as rows for Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.hangul import LETTERS, SYLLABLES
from ..functions.tags import CHAR_TAG, NUMBER
from ..operators.resources import Dictionaries

COMPOSITES = [(93, "I-VV:I-EP:0"), (94, "I-VA:I-ETM:0"), (95, "I-NNG:I-JX:0"), (96, "I-VX:I-EC:1"), (97, "B-XSV:I-EP:0")]
FIRSTS = [(93, 46 + NUMBER["VV"]), (94, 46 + NUMBER["VA"]), (95, 46 + NUMBER["NNG"]), (96, 46 + NUMBER["VX"]), (97, NUMBER["XSV"])]
_TAIL = {93: [(None, "VV", 1), ("었", "EP", 1)], 94: [(None, "VA", 1), ("ㄴ", "ETM", 1)], 95: [(None, "NNG", 1), ("는", "JX", 1)], 96: [(None, "VX", 1), ("아", "EC", 1), ("서", "EC", 1)], 97: [("하", "XSV", 0), ("였", "EP", 1)]}
#: chr, tag_out, vals; one in three keys is missing.
RESTORE = [(c, t, [(v or c, NUMBER[g], b) for v, g, b in _TAIL[t]]) for i, c in enumerate(SYLLABLES) for t, _ in COMPOSITES if (i + t) % 3]
#: key, is_pfx, tag_nums: exact and prefix entries, short and long ones that overlap.
PREANAL = [
    ("커저", False, [66, 47]), ("커저*", True, [66, 47]), ("커저머", True, [66, 66, 52]), ("머너서", True, [66, 66, 58]), ("머너", True, [81, 61]), ("라", True, [67]),
    ("라어", False, [68, 61]), ("어가", True, [66, 58]), ("자너", True, [77, 48]), ("자", True, [77]), ("타버타머", True, [66, 66, 58, 58]), ("퍼", False, [71]), ("더너", True, [66, 61]),
]
PREANAL = [(k.rstrip("*"), p, t) for k, p, t in PREANAL if not k.endswith("*")]


def made_tag(code: int, char_idx: int, word_idx: int) -> int:
    """The made-up tag of a character (base.MADE_TAG)."""
    return 93 + code % 5 if (code + char_idx) % 11 == 0 else 1 + (code * 7 + char_idx * 13 + word_idx * 5) % 92


def _patches() -> dict[tuple[int, ...], list[int]]:
    """Error patches of 1 to 6 items: characters, words, and both with a delimiter before or after; many overlap."""
    out = {}
    for k in range(0, 14):
        for word in ("커저", "머너서", "라어가", "자너어", "타버", "퍼", "더너"):
            own = [ord(c) * CHAR_TAG + made_tag(ord(c), i, k) for i, c in enumerate(word)]
            lefts = [own, own[:2], [-1, *own], [-1, own[0]], [*own, -1]]
            if k == 0:
                lefts = [own, [-2, own[0]], [-2, *own]]
            if word in ("퍼", "타버") or k % 5 == 1:
                lefts.append(own[:1])
            for left in lefts:
                out[tuple(left)] = [x if x < 0 else (x + len(left)) % 46 + 1 for x in left]
    return out


PATCHES = _patches()
DICTIONARIES = Dictionaries(
    {k: t for k, p, t in PREANAL if not p}, {k: t for k, p, t in PREANAL if p}, PATCHES, {(c, t): v for c, t, v in RESTORE}, dict(FIRSTS),
)


def restore_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESTORE, "chr string, tag_out int, vals array<struct<chr:string,tag:int,bi:int>>")


def firsts_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIRSTS, "tag_out int, first_tag int")


def preanal_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREANAL, "key string, is_pfx boolean, tag_nums array<int>")


def _values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join(rows) + ")"


RESTORE_SQL = "restore(chr, tag_out, vals) AS " + _values([f"('{c}', {t}, [" + ", ".join(f"{{'chr': '{x}', 'tag': {g}, 'bi': {b}}}" for x, g, b in v) + "])" for c, t, v in RESTORE])
FIRSTS_SQL = "firsts(tag_out, first_tag) AS " + _values([f"({a}, {b})" for a, b in FIRSTS])
PREANAL_SQL = "preanal(key, is_pfx, tag_nums) AS " + _values([f"('{k}', {str(p).lower()}, {t})" for k, p, t in PREANAL])
PATCHES_SQL = "pat(l, r, k, n) AS " + _values([f"({list(k)}, {v}, {k[0]}, {len(k)})" for k, v in PATCHES.items()])
HANGUL_SQL = f"translate(lower({{}}), '{LETTERS}', '{SYLLABLES}')"
