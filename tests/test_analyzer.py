"""The analyzer on known texts, with tags fed in by dictionaries; its resources, options, errors and streams; the network against loops."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanmal.analyzer import Analyzer, set_log_level
from hanmal.functions.tags import CHAR_TAG, NUMBER
from hanmal.operators import sentence as S
from hanmal.operators import tagger
from hanmal.operators.resources import Dictionaries, Model


def i(tag):
    return 46 + NUMBER[tag]


def b(tag):
    return NUMBER[tag]


COMPOSITE = {"I-VV:I-EP:0": 93, "I-VA:I-ETM:0": 94, "I-XSV:I-EC:0": 95, "I-VV:I-EC:0": 96, "I-VV:I-EC:1": 97, "I-VX:I-ETM:0": 98}
RESTORED = {
    ("됐", 93): [("되", b("VV"), 1), ("었", b("EP"), 1)], ("로", 94): [("롭", b("VA"), 1)], ("운", 94): [("ㄴ", b("ETM"), 1)], ("해", 95): [("하", b("XSV"), 1), ("여", b("EC"), 1)],
    ("혀", 96): [("히", b("VV"), 1), ("어", b("EC"), 1)], ("여", 97): [("이", b("VV"), 1), ("어", b("EC"), 1)], ("줄", 98): [("주", b("VX"), 1), ("ㄹ", b("ETM"), 1)],
}
EXACT = {
    "안녕?": [i("IC"), i("IC"), i("SF")], "새로운": [i("VA"), 94, 94], "세상~": [i("NNG"), i("NNG"), i("SO")],
    "됐어": [93, i("EC")], "사랑해": [i("NNG"), i("NNG"), 95], "먹혀": [i("VV"), 96], "보여줄": [i("VV"), 97, 98], "이더리움": [i("NNP")] * 4,
    "지저스크라이스트": [i("NNP")] * 7 + [i("NNG")], "지저스": [i("NNP")] * 3, "크라이스트": [i("NNP")] * 4 + [i("NNG")], "고타마싯다르타": [i("NNP")] * 7, "무함마드압둘라": [i("NNP")] * 5 + [i("NR"), i("NNP")],
}
FIRSTS = {93: i("VV"), 94: i("VA"), 95: i("XSV"), 96: i("VV"), 97: i("VV"), 98: i("VX")}


def mix(word, tags):
    return [ord(c) * CHAR_TAG + t for c, t in zip(word, tags, strict=True)]


PATCHES = {
    tuple(mix("지저스크라이스트", EXACT["지저스크라이스트"])): [i("NNP")] * 3 + [b("NNP")] + [i("NNP")] * 4,
    (*mix("지저스", EXACT["지저스"]), -1, *mix("크라이스트", EXACT["크라이스트"])): [i("NNP")] * 3 + [-1] + [i("NNP")] * 5,
    (-2, *mix("고타마싯다르타", EXACT["고타마싯다르타"])): [-2] + [i("NNP")] * 3 + [b("NNP")] + [i("NNP")] * 3,
    (*mix("무함마드압둘라", EXACT["무함마드압둘라"]), -2): [i("NNP")] * 4 + [b("NNP")] + [i("NNP")] * 2 + [-2],
}


@pytest.fixture(scope="module")
def analyzer():
    d = Dictionaries(EXACT, {"가즈아": [i("IC")] * 3}, PATCHES, RESTORED, FIRSTS)
    return Analyzer(Model.seeded(3, 8, 12, 98, "가나다라마바사"), d)


def morphs(analyzer, spark, text, options=None):
    row = analyzer.analyze(spark.createDataFrame([(text,)], "t string"), "t", options).first()["words"]
    return " + _ + ".join(" + ".join(f"{m.lex}/{m.tag}" for m in w.morphs) for w in row)


def test_words_and_byte_offsets(spark, analyzer):
    row = analyzer.analyze(spark.createDataFrame([("\x0b안녕? \t새로운 세상~\n",)], "t string"), "t").first()["words"]
    assert [(w.lex, w.b_begin, w.b_len, w.c_begin, w.c_len) for w in row] == [("안녕?", 1, 7, 1, 3), ("새로운", 10, 9, 6, 3), ("세상~", 20, 7, 10, 3)]
    assert [(m.lex, m.tag, m.b_begin, m.b_len) for w in row for m in w.morphs] == [("안녕", "IC", 1, 6), ("?", "SF", 7, 1), ("새롭", "VA", 10, 6), ("ㄴ", "ETM", 16, 3), ("세상", "NNG", 20, 6), ("~", "SO", 26, 1)]


@pytest.mark.parametrize(("text", "on", "off"), [("됐어", "되/VV + 었/EP + 어/EC", "됐/VV + 어/EC"), ("사랑해", "사랑/NNG + 하/XSV + 여/EC", "사랑/NNG + 해/XSV"), ("먹혀", "먹히/VV + 어/EC", "먹혀/VV"), ("보여줄", "보이/VV + 어/EC + 주/VX + ㄹ/ETM", "보여/VV + 줄/VX")])
def test_restoring(spark, analyzer, text, on, off):
    assert morphs(analyzer, spark, text) == on and morphs(analyzer, spark, text, '{"restore": false}') == off


@pytest.mark.parametrize(
    ("text", "wrong", "right"),
    [
        ("지저스크라이스트", "지저스크라이스/NNP + 트/NNG", "지저스/NNP + 크라이스트/NNP"), ("지저스 크라이스트", "지저스/NNP + _ + 크라이스/NNP + 트/NNG", "지저스/NNP + _ + 크라이스트/NNP"),
        ("고타마싯다르타", "고타마싯다르타/NNP", "고타마/NNP + 싯다르타/NNP"), ("무함마드압둘라", "무함마드압/NNP + 둘/NR + 라/NNP", "무함마드/NNP + 압둘라/NNP"),
        ("됐어 고타마싯다르타", "되/VV + 었/EP + 어/EC + _ + 고타마싯다르타/NNP", "되/VV + 었/EP + 어/EC + _ + 고타마싯다르타/NNP"),
    ],
)
def test_error_patches(spark, analyzer, text, wrong, right):
    assert morphs(analyzer, spark, text, '{"errpatch": false}') == wrong and morphs(analyzer, spark, text) == right


def test_preanal(analyzer):
    tags = lambda w: S.preanal(w, analyzer.dictionaries, analyzer.dictionaries.longest())
    assert all(tags("이더리움")) and not any(tags("이더리움을")) and not any(tags("이더륨")) and tags("") == []
    assert [t > 0 for t in tags("가즈아~")] == [True, True, True, False] and all(tags("가즈아")) and not any(tags("가자"))


def test_before_patch_layout(spark, analyzer):
    df = spark.createDataFrame([("진정한 테스트입니다.",), ("",), (" \t",), (None,), ("지저스",)], "t string")
    rows = [r.tags for r in analyzer.tags_before_patch(df, "t").collect()]
    assert len(rows[0]) == 13 and [k for k, t in enumerate(rows[0]) if t < 0] == [0, 4, 12] and rows[0][4] == -1 and rows[0][0] == rows[0][12] == -2
    assert rows[1] == rows[2] == [-2] and rows[3] is None and rows[4] == [-2, *EXACT["지저스"], -2]


def test_blank_null_and_nul(spark, analyzer):
    df = spark.createDataFrame([(1, ""), (2, " \n"), (3, None), (4, "됐어\0 사랑해")], "id int, t string")
    got = {r.id: r.words for r in analyzer.analyze(df, "t").collect()}
    assert got[1] == got[2] == [] and got[3] is None and [w.lex for w in got[4]] == ["됐어"]


def test_options_and_errors(spark, analyzer, tmp_path):
    with pytest.raises(ValueError):
        analyzer._chosen('{"restore": 3}')
    with pytest.raises(ValueError):
        analyzer._chosen("{bad")
    assert analyzer._chosen('{"other": 1}') == analyzer.options and analyzer._chosen(None, preanal=False).preanal is False
    for path in (str(tmp_path / "nowhere"), str(tmp_path)):
        with pytest.raises(FileNotFoundError):
            Analyzer.open(path)
    (tmp_path / "file").write_text("x")
    with pytest.raises(FileNotFoundError):
        Analyzer.open(str(tmp_path / "file"))
    analyzer.save(str(tmp_path / "rsc"))
    with Analyzer.open(str(tmp_path / "rsc"), errpatch=False) as again:
        assert again.dictionaries == analyzer.dictionaries and morphs(again, spark, "고타마싯다르타") == "고타마싯다르타/NNP"
        assert np.array_equal(again.model.embed, analyzer.model.embed) and again.model.chars == analyzer.model.chars
    with pytest.raises(ValueError, match="closed"):
        again.analyze(spark.range(1), "id")
    set_log_level("warning")
    set_log_level("debug", "tagger")
    with pytest.raises(ValueError):
        set_log_level("loud")


def test_model_shapes():
    m = Model.seeded(2, 4, 6, 97, "가나")
    state = {"embedding.weight": m.embed, "hidden.weight": m.hidden[0].T, "hidden.bias": m.hidden[1], "tag.weight": m.out[0].T, "tag.bias": m.out[1]}
    for k, (w, bias) in m.filters.items():
        state |= {f"convs.{k}.weight": w.reshape(k, 4, 4).transpose(2, 1, 0), f"convs.{k}.bias": bias}
    again = Model.from_state(state, "가나", 2)
    assert all(np.array_equal(again.filters[k][0], m.filters[k][0]) for k in m.filters) and np.array_equal(again.out[0], m.out[0])
    state["hidden.bias"] = m.hidden[1][:3]
    with pytest.raises(ValueError, match="shapes"):
        Model.from_state(state, "가나", 2)
    with pytest.raises(ValueError, match="classes"):
        Model.seeded(2, 4, 6, 50, "가나")


def loops(m, words):
    """Tags of one sentence by plain loops over characters, places, filters and weights."""
    flat = [(w, j) for w in words for j in range(len(w))]
    ids = [m.chars.get(w[j], 1) for w, j in flat]
    size, width, out = 2 * m.window + 1, m.embed.shape[1], []
    for n, (w, j) in enumerate(flat):
        x = []
        for p in range(size):
            at = n + p - m.window
            v = [float(e) for e in m.embed[ids[at] if 0 <= at < len(flat) else 0]]
            if p == m.window - j:
                v = [a + float(e) for a, e in zip(v, m.embed[2], strict=True)]
            if p == m.window + len(w) - j - 1:
                v = [a + float(e) for a, e in zip(v, m.embed[3], strict=True)]
            x.append([a + 1 - (p + 1) / size - (k + 1) / width * (1 - 2 * (p + 1) / size) for k, a in enumerate(v)])
        f = []
        for k, (weight, bias) in m.filters.items():
            for o in range(width):
                f.append(max(0.0, max(sum(x[r + q][e] * float(weight[q * width + e][o]) for q in range(k) for e in range(width)) for r in range(size - k + 1)) + float(bias[o])))
        h = [max(0.0, sum(a * float(c) for a, c in zip(f, m.hidden[0][:, o], strict=True)) + float(m.hidden[1][o])) for o in range(m.hidden[0].shape[1])]
        y = [sum(a * float(c) for a, c in zip(h, m.out[0][:, o], strict=True)) + float(m.out[1][o]) for o in range(m.classes)]
        out.append(1 + y.index(max(y)))
    return out


def test_network_by_loops():
    m = Model.seeded(3, 8, 12, 98, "가나다라마바사")
    sentences = [["가나다", "하"], ["마바사아자차"], [], ["라", "라", "라라"]]
    got = tagger.predict(m, sentences, [[[0] * len(w) for w in s] for s in sentences])
    assert [[t for w in s for t in w] for s in got] == [loops(m, s) for s in sentences]
    known = tagger.predict(m, [["가나다"]], [[[5, 0, 60]]])
    assert known[0][0][0] == 5 and known[0][0][2] == 60 and known[0][0][1] == loops(m, ["가나다"])[1]


def test_sinusoid():
    p = tagger.positions(5, 4, "sinusoid")
    assert p.shape == (5, 4) and math.isclose(p[2, 0], math.sin(3)) and math.isclose(p[2, 1], math.cos(3))


def test_sql_function(spark, analyzer):
    analyzer.register(spark, "analyze_text")
    got = spark.sql("SELECT analyze_text('됐어 사랑해') AS w").first()["w"]
    assert [(x.lex, x.morphs) for x in got] == [("됐어", "되/VV + 었/EP + 어/EC"), ("사랑해", "사랑/NNG + 하/XSV + 여/EC")]


def test_no_shuffle(spark, analyzer):
    plan = analyzer.analyze(spark.range(9).select(F.col("id").cast("string").alias("t")), "t")._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_stream(spark, analyzer, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("됐어\n사랑해 먹혀\n\n", encoding="utf-8")
    from hanmal.streaming import analyze_files

    q = analyze_files(spark, analyzer, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True)
    q.awaitTermination()
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect() if r.value)
    assert got == sorted(["됐어\t되/VV + 었/EP + 어/EC", "사랑해\t사랑/NNG + 하/XSV + 여/EC", "먹혀\t먹히/VV + 어/EC"])


def test_command_line(spark, analyzer, tmp_path):
    from hanmal.__main__ import main

    analyzer.save(str(tmp_path / "rsc"))
    (tmp_path / "in.txt").write_text("됐어\n고타마싯다르타\n", encoding="utf-8")
    main(["analyze", "--resources", str(tmp_path / "rsc"), "--input", str(tmp_path / "in.txt"), "--output", str(tmp_path / "out")], spark)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect() if r.value] == ["됐어\t되/VV + 었/EP + 어/EC", "고타마싯다르타\t고타마/NNP + 싯다르타/NNP"]
    main(["analyze", "--resources", str(tmp_path / "rsc"), "--input", str(tmp_path / "in.txt"), "--output", str(tmp_path / "tags"), "--errpatch"], spark)
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "tags")).collect()] == [[-2, *EXACT["됐어"], -2], [-2, *EXACT["고타마싯다르타"], -2]]
