"""Every query with an SQL twin against DuckDB, and defined results of the text functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from hanmal import plans, version
from hanmal.functions import hangul, morphs, tags, text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else [show(y) for y in x] if isinstance(x, (list, tuple)) else x
    return sorted(columns), sorted(str([show(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", plans.ORACLE_SQL)
def test_sql_twin(spark, duck, sf, name):
    df = plans.QUERIES[name](spark, sf)
    found = duck.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("given", "want"), [("안녕? 새로운", ["안녕?", "새로운"]), ("\x0b\t a　b\n", ["a", "b"]), ("a\x0cb c", ["a\x0cb c"]), ("", []), ("   ", []), (None, None)])
def test_words(spark, given, want):
    assert one(spark, given, text.words) == want


def test_offsets(spark):
    rows = text.tokenize(spark.createDataFrame([(1, "\x0b\t안녕?\t새로운 😀세상~\n"), (2, ""), (3, None)], "id int, t string"), "t", "id").collect()
    assert [(r.id, r.lex, r.c_begin, r.c_len, r.b_begin, r.b_len) for r in rows] == [(1, "안녕?", 2, 3, 2, 7), (1, "새로운", 6, 3, 10, 9), (1, "😀세상~", 10, 4, 20, 11)]


def test_offsets_of_a_long_line(spark):
    rows = text.tokenize(spark.range(1).select("id", F.repeat(F.lit("abcd "), 50_000).alias("t")), "t", "id")
    assert rows.agg(F.count("*"), F.max("c_begin"), F.max("b_begin")).first() == (50_000, 249_995, 249_995)


@pytest.mark.parametrize("given", ["각힣가", "abc", "", "ㄱ한x글"])
def test_jamo(spark, given):
    assert one(spark, given, hangul.decompose) == hangul.decompose_str(given)


def test_morph_grammar(spark):
    got = one(spark, "새롭/VA + ㄴ/ETM + _ + a/XX + x + /NNG + //SP", morphs.parse)
    assert [(m.lex, m.tag, m.error) for m in got][:3] == [("새롭", "VA", None), ("ㄴ", "ETM", None), ("_", "", None)]
    assert [m.error for m in got[3:]] == ["bad tag", "no tag", "no lex", None] and (got[6].lex, got[6].tag) == ("/", "SP")


def test_tags():
    assert len(tags.TAGS) == 46 and len(tags.SIMPLE) == 92 and tags.to_numbers("I-NNG") == 46 + tags.NUMBER["NNG"] and version()
