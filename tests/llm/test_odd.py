"""The documented results on nulls, empty and very long texts, repeated rows and ties, value by value."""

import math

import pytest

from hanmal.llm import mil_quality, mixing, packing, quality_rules, secret_scan, substring_dedup, telephony
from hanmal.llm.tokens import count_tokens

from .test_operators import frame, prose

LONG = prose(1, 30_000)
ROWS = [(1, prose(2, 80), "en", "a"), (1, prose(2, 80), "en", "a"), (1, prose(3, 80), None, None), (None, prose(2, 80), "en", "a"), (None, None, None, None), (2, "", "de", "b"), (3, None, "fr", "b"), (4, LONG, "en", "b"), (5, LONG, "en", "b"), (6, "  \n \n", "en", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 0, 0), (None, 1, 0), (4, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")


def test_mil(odd, labels):
    got = mil_quality.apply(odd, labels).collect()
    assert sorted((r.doc_id or 0, r.passages) for r in got) == sorted((i or 0, len(mil_quality.passages(t))) for i, t, _, _ in ROWS)
    assert {r.passages for r in got if r.doc_id in (2, 3, 6)} == {1} and all(0 <= r.score <= 1 and 0 < r.top_weight <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1 and len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert all(r.score == 0.5 for r in mil_quality.apply(odd, labels.limit(0)).collect())


def test_packing(odd):
    got = packing.apply(odd).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, count_tokens(t)) for i, t, _, _ in ROWS)
    first = sorted((r for r in got if r.bucket == 0), key=lambda r: (r.batch, r.slot))
    assert [r.doc_id for r in first][0] is None and [r.doc_id for r in first][1:] == sorted(r.doc_id for r in first if r.doc_id is not None)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(ROWS)


def test_secrets(spark, odd):
    assert secret_scan.scan(odd).collect() == []
    text = 'password = "aK9x2Lq8Zt5Rw1Vb"'
    got = secret_scan.scan(frame(spark, [(None, text, "en", "a"), (7, text + "\n" + text, "en", "a"), (7, text + "\n" + text, "en", "a")])).collect()
    assert sorted((r.doc_id or 0, r.begin) for r in got) == [(0, 12), (7, 12), (7, 12), (7, 42), (7, 42)] and {r.masked for r in got} == {"aK9x…"}


def test_telephony(odd):
    got = {}
    for r in telephony.to_pcm(telephony.clips_of(odd), "doc_id").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(ROWS) and got[3][0].pcm is None and got[3][0].n_samples == 0 and got[3][0].error is None
    assert bytes(got[2][0].pcm) == b"" and got[1][0].codec == "alaw" and {r.codec for r in got[None]} == {"mulaw"}
    assert sorted(r.n_samples for r in got[None]) == [0, 2 * len(ROWS[3][1])] and all(len(r.pcm or b"") == 2 * r.n_samples for rs in got.values() for r in rs)


def test_repeats(odd):
    assert [(r.doc_id, r.begin, r.end, r.kept_doc_id) for r in substring_dedup.repeats(odd).collect()] == [(5, 0, len(LONG), 4)]
    got = [(r.doc_id, r.text, r.kept_spans) for r in substring_dedup.clean(odd).collect()]
    want = [(i, t if i != 5 else "", None if i != 5 else []) for i, t, _, _ in ROWS]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rules(odd, labels):
    assert quality_rules.apply(odd, labels).count() == quality_rules.apply(odd, labels.limit(0)).count() == len(ROWS)
    values = quality_rules.rule_values(["", None])
    assert all((values[r] == (2 if r == "shortness" else 0)).all() for r in quality_rules.RULES)


def test_mixing(odd, labels):
    got = mixing.rated(odd, labels).collect()
    assert len(got) == len(ROWS) and all(r.n_tokens == 0 for r in got if r.doc_id in (2, 3)) and all(math.isclose(sum(r[c] for c in mixing.P), 1) for r in got)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got) and len({r.copies for r in got if r.doc_id == 1 and r.fp == got[0].fp}) <= 1
    even = mixing.rated(odd, labels.limit(0)).collect()
    assert all(math.isclose(r[c], 1 / 3) for r in even for c in mixing.P) and all(r.unmet > 0.5 for r in even)
