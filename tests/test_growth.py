"""Queries that must not shuffle, hold or repeat more than their input grows."""

import pytest
from pyspark.sql import functions as F

from hanmal import plans
from hanmal.operators import patch


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["patch_leftovers", "corpus_diff", "corpus_apply_patch", "boundary_diff", "typed_lines"])
def test_documents_are_patched_in_place(spark, sf, name):
    assert "hashpartitioning" not in plan(plans.QUERIES[name](spark, sf))


def test_diff_is_in_order(spark, sf):
    got = [(r.doc, r.wid) for r in plans.QUERIES["corpus_diff"](spark, sf).collect()]
    assert got == sorted(got) and len(got) > 1000


def lines(spark, rows):
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc string, line_no int, type string, wid string, content string")


def test_patches_of_tables(spark):
    bos, eos = ("BOS", None, "<p>"), ("EOS", None, "</p>")
    w = lambda n, c="x": ("WORD", f"AAAA0001-{n:08d}", c)
    old = lines(spark, [bos, w(1), w(2), eos, bos, w(5), w(6), eos])
    new = lines(spark, [bos, w(0, "first"), w(1), w(2, "y"), w(3), w(4), w(5), eos, bos, w(7), eos])
    made = patch.make(old, new)
    assert sorted((r.op, r.wid[-1], r.content) for r in made.where("op not in ('M', 'S')").collect()) == [("+", "0", "first"), ("+", "3", "x"), ("+", "4", "x"), ("+", "7", "x"), ("-", "6", ""), ("=", "2", "y")]
    assert [(r.op, r.wid[-1], r.content[-1]) for r in made.where("op in ('M', 'S')").orderBy("op").collect()] == [("M", "2", "5"), ("S", "5", "7")]
    assert plan(made).count("hashpartitioning") == 2
    got = patch.apply(old, made.where("op != 'S'")).orderBy("line_no").collect()
    assert [r.wid[-1] if r.wid else r.content for r in got] == ["0", "<p>", "1", "2", "3", "4", "5", "7", "</p>"]
    assert sorted(r.wid[-1] for r in patch.leftovers(new, made).collect()) == ["6"]
    assert made.where(F.col("doc").isNull()).count() == 0


def test_ids_are_looked_up_once(monkeypatch):
    from hanmal.operators import tagger
    from hanmal.plans.tagger_queries import model

    seen = []
    monkeypatch.setattr(tagger, "BLOCK", 16)
    monkeypatch.setattr(type(model()), "codes", lambda self, own=type(model()).codes: seen.append(1) or own(self))
    sents = [["가나다라", "뷁"], [], ["거너" * 40]]
    got = tagger.predict(model(), sents, [[[0] * len(w) for w in s] for s in sents])
    assert len(seen) == 1 and [[len(w) for w in s] for s in got] == [[4, 1], [], [80]]
    monkeypatch.setattr(tagger, "BLOCK", 4096)
    assert got == tagger.predict(model(), sents, [[[0] * len(w) for w in s] for s in sents])


def test_batches_are_cut_by_size():
    import pyarrow as pa

    from hanmal.operators.batches import pieces

    batch = pa.RecordBatch.from_pydict({"a": list(range(50)), "t": ["x" * (1000 if i != 7 else 50_000) for i in range(50)]})
    got = list(pieces(batch, [1], 8000))
    assert [x for p in got for x in p.column(0).to_pylist()] == list(range(50))
    assert all(p.num_rows == 1 or p.column(1).nbytes <= 8000 for p in got) and len(got) < 20


def test_contexts_are_linear(spark):
    """A long line: the padded sentence is made once, not for each character."""
    import time

    from hanmal.operators import analyzer

    df = spark.createDataFrame([([[1, 2], [3]],), ([],), ([[k % 9 for k in range(60_000)]],)], "ids array<array<int>>")
    began = time.time()
    got = [r.contexts for r in analyzer.contexts(df, "ids", 2).collect()]
    assert got[:2] == [[[[0, 0, 1, 2, 3], [0, 1, 2, 3, 0]], [[1, 2, 3, 0, 0]]], []] and len(got[2][0]) == 60_000 and time.time() - began < 60


def test_restored_alike(spark):
    from hanmal.operators import analyzer
    from hanmal.operators.resources import Dictionaries

    d = Dictionaries(restored={("됐", 93): [("되", 37, 1), ("었", 2, 1)], ("가", 93): [("가", 37, 1)]}, firsts={93: 83})
    df = spark.createDataFrame([(["됐", "가", "나", "가됐"], [[93], [93], [93], [50, 93]])], "words array<string>, tags array<array<int>>")
    assert analyzer.restored_alike(df, d).first().same == [False, True, True, False]


@pytest.mark.parametrize("name", ["cnn_tags", "same_restored", "analyze_patched", "restore_chars", "context_windows"])
def test_small_tables_are_spread(spark, sf, name):
    assert "REPARTITION_BY_NUM" in plan(plans.QUERIES[name](spark, sf))


def test_matching_blocks_are_those_of_difflib(monkeypatch):
    import difflib
    import random

    from hanmal.operators import mining

    r = random.Random(5)
    for few in (1, 128):
        monkeypatch.setattr(mining, "FEW", few)
        for t in range(1500):
            kinds, n = r.choice([1, 2, 3, 5, 20, 200]), r.choice([0, 1, 5, 12, 30]) if t % 40 else 250
            a = [str(r.randrange(kinds)) for _ in range(n)]
            b = list(a) if r.random() < 0.6 else [str(r.randrange(kinds)) for _ in range(r.choice([0, 3, 12]))]
            for _ in range(r.randrange(5) if b else 0):
                i = r.randrange(len(b) + 1)
                b[i : i + r.randrange(3)] = [str(r.randrange(kinds + 1)) for _ in range(r.randrange(3))]
            assert mining.matching_blocks(a, b) == [tuple(x) for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks()]


def test_long_repetitive_sentence_is_mined():
    """8,000 words of 50 kinds: took over a minute when each row was compared item by item."""
    import time

    from hanmal.operators import mining

    words = [(str(i * i % 101 % 50), [f"{i * i % 101 % 50}/NNG"], [f"{i * i % 101 % 50}/NN{'P' if i % 7 == 0 else 'G'}"]) for i in range(8000)]
    began = time.process_time()
    assert len(list(mining.sentence_triples(words))) > 1000 and time.process_time() - began < 30


def test_mining_groups_only_triples(spark, sf):
    assert plan(plans.QUERIES["extract_errpatch"](spark, sf)).count("hashpartitioning") == 1


@pytest.mark.parametrize("name", ["score_report", "morph_fscore", "sentence_texts", "read_gold", "training_words", "final_symbols"])
def test_words_are_not_shuffled_by_key(spark, sf, name):
    assert "hashpartitioning" not in plan(plans.QUERIES[name](spark, sf))


def test_morphemes_are_counted_by_word(spark):
    from hanmal.operators import evaluate

    rows = [(1, ["a"], ["a"]), (2, ["a"], ["a", "a"]), (3, ["a", "a", "b"], ["b", "a", "a", "a"]), (4, None, ["a"]), (5, [], []), (6, ["a", None], ["a", None]), (7, ["a"], ["b"])]
    df = spark.createDataFrame(rows, "id int, gold array<string>, pred array<string>")
    assert tuple(evaluate.morph_counts(df, ["id"]).first()) == (8, 11, 5)
    assert tuple(evaluate.morph_counts(df.where("id = 0"), ["id"]).first()) == (0, 0, 0)


def test_gold_words_are_taken_apart_once(spark, sf):
    """The pattern of a final symbol stood in the plan for each use of the word's stem."""
    from hanmal.plans.base import gold_words

    assert plan(gold_words(spark, sf)).count("RLIKE") + plan(gold_words(spark, sf)).count("regexp_replace") <= 2


def test_file_words_are_those_of_tables(spark):
    from hanmal.sources import corpus

    w = "AAAA0001-0000000"
    lines = ["x", "<p>", f"{w}1\t가\t가/NNG", f"{w}2\t가 나\t가/NNG", "</p>", f"{w}3\t가\t가/NNG", "<l>", f"{w}4\t가", f"{w}5\ta\ta/XX", f"{w}6\ta/b\ta//b/SL + ./SF", f"{w}7\t가\t/NNG", f"{w}8\tㄱ\tᄀ/NNG + x", f"{w}9\tㄱ\tᄀ/NNG", "</l>", "<p>", "", f"{w}1\t\t", f"{w}2\tÅ\tÅ/SL", "<date>"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    for codes in (False, True):
        want = sorted(((r.sent, r.word_idx, r.wid, r.raw, None if r.morphs is None else [tuple(m) for m in r.morphs], r.error) for r in corpus.gold_words(df, codes).collect()), key=str)
        assert sorted((tuple(x) for x in corpus.file_words(lines, codes)), key=str) == want and len(want) == 10
        assert sorted(r.wid for r in corpus.good_sentences(corpus.gold_words(df, codes)).collect()) == sorted(x.wid for x in corpus.good_words(corpus.file_words(lines, codes)))
    train = ["", "a\tX Y", "b", " ", "  ", "c\tZ\tq", "", "d\tX"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(train)], "file string, line_no int, line string")
    for last in (False, True):
        assert sorted(((r.sent, r.word_idx, r.raw, r.tags) for r in corpus.training_words(df, last).collect()), key=str) == sorted(corpus.file_training_words(train, last), key=str)


def test_characters_are_sent_in_parts(spark, monkeypatch):
    from hanmal.functions import scan, text

    texts = ["가a😀", "", "b\0c", "é" * 9, "", "x"]
    want = [(k, i, c, len(t.partition("\0")[0][:i].encode())) for k, t in enumerate(texts) for i, c in enumerate(t.partition("\0")[0])]
    for most in (1, 2, 3, 100):
        parts = list(scan.Scan(texts).chars(most))
        got = [(int(o), int(i), c, int(b)) for p in parts for o, i, c, b in zip(p["owner"], p["char_idx"], p["chr"].to_pylist(), p["b_begin"], strict=True)]
        assert got == want and all(len(p["owner"]) <= most for p in parts)
    assert text.char_table(spark.range(2).select("id", F.repeat(F.lit("가b"), 100_000).alias("t")), "t", "id").agg(F.count("*"), F.max("b_end"), F.max("char_idx")).first() == (400_000, 400_000, 199_999)


def test_offsets_of_many_texts_at_once():
    from hanmal.functions import scan

    texts = ["가a😀", None, "", "b\0c", "ab", "x"]
    places = [[0, 3, 4, 8, 99, -1], [1], [0, 5], [0, 1, 2, 3], None, []]
    assert scan.chars_at_bytes(texts, places).to_pylist() == [[0, 1, 2, 3, 5, 0], None, [0, 2], [0, 1, 2, 3], None, []]
    assert len(scan.chars_at_bytes([], [])) == 0


def test_sentences_are_aligned_in_place(spark, sf):
    assert "hashpartitioning" not in plan(plans.QUERIES["tag_corpus"](spark, sf))
    for name in ("restore_table", "restore_examples"):
        assert plan(plans.QUERIES[name](spark, sf)).count("MapInArrow") == 1


def test_tag_corpus_of_tables(spark):
    from hanmal.operators import align

    rows = [(1, 0, "한", [("하", "VV"), ("ㄴ", "ETM")]), (1, 1, "가", [("가", "NNG")]), (2, 0, "나", [("나", "NP")]), (2, 1, None, [("가", "NNG")]), (3, 0, "가나", [("가", "NNG")]), (4, 0, "한", [("하", "VX"), ("ㄴ", "ETM")]), (5, 0, "한", None)]
    df = spark.createDataFrame(rows, "s int, word_idx int, raw string, morph_list array<struct<lex:string,tag:string>>")
    words, table = align.tag_corpus(df, ["s"])
    assert sorted((r.s, r.word_idx, r.raw, r.tags) for r in words.collect()) == [(1, 0, "한", ["I-VV:I-ETM:0"]), (1, 1, "가", ["I-NNG"]), (4, 0, "한", ["I-VX:I-ETM:0"])]
    assert sorted((r.chr, r.tag, r.vals, r.num) for r in table.collect()) == [("한", "I-VV:I-ETM", "하/I-VV ㄴ/I-ETM", 0), ("한", "I-VX:I-ETM", "하/I-VX ㄴ/I-ETM", 0)]


def test_evidence_is_counted_in_the_workers(spark, sf):
    from hanmal.operators import mining

    df = spark.createDataFrame([([1, 2, 1, 2, 3], [5, 6, 5, 9, 3]), ([], []), (None, [1]), ([2, 1, 2], [0, 5, 6])], "mix array<bigint>, gold array<bigint>")
    got = {tuple(r.left): (r.n_right, r.n_wrong) for r in mining.patch_evidence(df, {(1, 2): [5, 6], (3,): [1], (9,): [9]}).collect()}
    assert got == {(1, 2): (2, 1), (3,): (0, 1)}
    found = plan(plans.QUERIES["validate_patches"](spark, sf))
    assert found.count("MapInArrow") == 1 and "Generate explode" not in found.split("MapInArrow")[0]
