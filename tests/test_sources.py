"""Readers and writers of files, and mining on small cases."""

import os

from pyspark.sql import functions as F

from hanmal.operators import mining, patch, vocab
from hanmal.sources import corpus
from hanmal.sources.dictionaries import Options


def test_read_lines(spark, tmp_path):
    (tmp_path / "b.txt").write_text("가\r\n나\n\n", encoding="utf-16")
    (tmp_path / "a.txt").write_text("x\nend\ny\n", encoding="utf-16")
    got = corpus.read_lines(spark, str(tmp_path), "UTF-16", {"a.txt": "end"}).orderBy("file", "line_no").collect()
    assert [(r.file, r.line_no, r.line) for r in got] == [("a.txt", 0, "x"), ("a.txt", 1, "end"), ("b.txt", 0, "가"), ("b.txt", 1, "나"), ("b.txt", 2, "")]


def test_split_sink(spark, tmp_path):
    corpus.write_split(spark.range(9).select("id", F.element_at(F.array(F.lit("dev"), F.lit("test"), F.lit("train")), (F.col("id") % 3 + 1).cast("int")).alias("split")), str(tmp_path / "s"))
    assert {x for x in os.listdir(tmp_path / "s") if "=" in x} == {"split=dev", "split=test", "split=train"} and spark.read.parquet(str(tmp_path / "s")).count() == 9


def test_patch_files(spark, tmp_path):
    """Files hold sentence patches first, in order; a document that has no patches any more loses its file."""
    path = str(tmp_path / "p")
    rows = [("d1", "=", "w2", "x"), ("d1", "-", "w1", ""), ("d1", "S", "w1", "w2"), ("d2", "+", "w3", "y")]
    patches = spark.createDataFrame(rows, "doc string, op string, wid string, content string")
    patch.write(patches, path)
    assert [r.value for r in spark.read.text(path).where("doc = 'd1'").collect()] == ["S\tw1\tw2", "-\tw1", "=\tw2\tx"]
    patch.write(patches.where("doc = 'd2'"), path)
    assert [r.doc for r in spark.read.text(path).collect()] == ["d2"]
    lines = spark.read.text(path).select("doc", F.lit(0).alias("line_no"), F.col("value").alias("line"))
    assert [(r.op, r.wid, r.content, r.error) for r in patch.parse(lines).collect()] == [("+", "w3", "y", None)]


def word(raw, pred, gold):
    m = lambda s: [dict(zip(("lex", "tag"), x.rsplit("/", 1), strict=True)) for x in s.split(" + ")]
    return {"raw": raw, "pred": m(pred), "morph_list": m(gold)}


def test_differences():
    assert mining.difference([word("가", "가/NNG", "가/NNG")]) is None
    got = list(mining.difference([word("가나", "가/NNG + 나/NNG", "가나/NNP"), word("다", "다/EF", "다/EF")]).triples())
    assert ("가나", "가/NNG + 나/NNG", "가나/NNP") in got
    assert ("가나", "| + 가/NNG + 나/NNG", "| + 가나/NNP") in got
    assert ("가나 ", "가/NNG + 나/NNG + _", "가나/NNP + _") in got
    assert ("가나 다", "가/NNG + 나/NNG + _ + 다/EF", "가나/NNP + _ + 다/EF") in got  # one more beyond the space
    assert all(a != b for _, a, b in got)


def test_error_triples_and_evidence(spark):
    words = [(s, 0, *[word("가나", "가/NNG + 나/NNG", "가나/NNP")[k] for k in ("raw", "morph_list", "pred")]) for s in range(6)]
    m = "array<struct<lex:string,tag:string>>"
    df = spark.createDataFrame(words, f"sent int, word_idx int, raw string, morph_list {m}, pred {m}")
    counted = vocab.error_counts(mining.error_triples(mining.sentences(df, ["sent"])), 5, 2).collect()
    assert {(r.origin, r.left, r.right, r.freq) for r in counted} >= {("가나", "가/NNG + 나/NNG", "가나/NNP", 6)}
    sents = spark.createDataFrame([([1, 2, 1, 2, 1], [5, 6, 5, 7, 1]), ([1, 1, 1], [9, 9, 1])], "mix array<bigint>, gold array<int>")
    got = {tuple(r.left): (r.n_right, r.n_wrong) for r in mining.patch_evidence(sents, {(1, 2): [5, 6], (1, 1): [9, 9], (3,): [1]}).collect()}
    assert got == {(1, 2): (1, 1), (1, 1): (1, 0)}
    assert [tuple(r.left) for r in mining.valid_patches(mining.patch_evidence(sents, {(1, 2): [5, 6], (1, 1): [9, 9]})).collect()] == [(1, 1)]
    assert list(mining.occurrences([1, 1, 1, 1, 2], {1: [(1, 1), (1, 2)]})) == [((1, 1), 0), ((1, 1), 2), ((1, 2), 3)]


def test_options(tmp_path):
    (tmp_path / "c.json").write_text('{"window": 3, "embed_dim": 30, "other": 1}')
    assert Options.load(str(tmp_path / "c.json")).window == 3
    (tmp_path / "d.json").write_text('{"window": 0}')
    try:
        Options.load(str(tmp_path / "d.json"))
    except ValueError as e:
        assert "window" in str(e)
    else:
        raise AssertionError
