"""Tables that the trial queries start from, for both engines, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hangul, text
from ..operators.analyzer import char_rows
from ..operators.sizes import spread
from .fixtures import HANGUL_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SP = r"[ \t\x0b\r\n\x{3000}]"
NSP = r"[^ \t\x0b\r\n\x{3000}]"


def query(sql: str | None = None) -> Callable:
    """Registers a query, with its SQL twin if it has one."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of documents up to which they are read by fewer tasks than there are cores.
FEW_TASKS = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"), FEW_TASKS)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, in syllables."""
    return spread(load(spark, sf_dir, "conversations")).withColumn("text", hangul.from_latin(F.col("text")))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")


LINES = "lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_idx, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
WORDS = rf"""pieces AS (SELECT doc_id, line_idx, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT *, regexp_extract_all(line, '{SP}*{NSP}+') AS p FROM lines)),
words AS (SELECT doc_id, line_idx, CAST(i - 1 AS INTEGER) AS word_idx, regexp_extract(piece, '{NSP}+') AS lex,
  CAST(sum(length(piece)) OVER w - length(regexp_extract(piece, '{NSP}+')) AS INTEGER) AS c_begin,
  CAST(sum(strlen(piece)) OVER w - strlen(regexp_extract(piece, '{NSP}+')) AS INTEGER) AS b_begin
  FROM pieces WINDOW w AS (PARTITION BY doc_id, line_idx ORDER BY i))"""


def hangul_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, line_idx, word_idx, word of the conversations, in syllables."""
    each = text.lines(turns(spark, sf_dir), "text", "conv_id", "turn")
    return each.select("conv_id", "turn", "line_idx", F.posexplode(text.words(F.col("line"))).alias("word_idx", "word"))


WORD = ["conv_id", "turn", "line_idx", "word_idx"]
SENT = ["conv_id", "turn", "line_idx"]
HWORDS = rf"""tl AS (SELECT conv_id, turn, string_split({HANGUL_SQL.format('text')}, chr(10)) AS ls FROM conversations),
tl2 AS (SELECT conv_id, turn, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_idx FROM tl),
hwords AS (SELECT conv_id, turn, line_idx, unnest(p) AS word, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS word_idx
  FROM (SELECT *, regexp_extract_all(line, '{NSP}+') AS p FROM tl2))"""


def hangul_sentences(spark: SparkSession, sf_dir: str, zeros: bool = False) -> DataFrame:
    """conv_id, turn, line_idx, words and tags: for each character a made-up output tag that depends on it and its place; zeros: some are 0."""
    s = text.lines(turns(spark, sf_dir), "text", "conv_id", "turn").select("conv_id", "turn", "line_idx", text.words(F.col("line")).alias("words"))

    def tag(chr_, i, k):
        code = F.ascii(chr_)
        made = F.when((code + i) % 11 == 0, 93 + code % 5).otherwise(1 + (code * 7 + i * 13 + k * 5) % 92)
        return (F.when((code + i) % 7 == 3, 0).otherwise(made) if zeros else made).cast("int")

    return s.withColumn("tags", F.transform("words", lambda w, k: F.transform(F.split(w, ""), lambda c, i: tag(c, i, k))))


def hangul_chars(spark: SparkSession, sf_dir: str, zeros: bool = False) -> DataFrame:
    """One row for each character of hangul_sentences, with tag_out."""
    return char_rows(hangul_sentences(spark, sf_dir, zeros), SENT, "tags").withColumnRenamed("tags", "tag_out")


HCHARS = """hc0 AS (SELECT *, unnest(string_split(word, '')) AS chr, CAST(generate_subscripts(string_split(word, ''), 1) - 1 AS INTEGER) AS char_idx FROM hwords),
hchars AS (SELECT *, CAST(CASE WHEN (unicode(chr) + char_idx) % 11 = 0 THEN 93 + unicode(chr) % 5 ELSE 1 + (unicode(chr) * 7 + char_idx * 13 + word_idx * 5) % 92 END AS INTEGER) AS tag_out FROM hc0)"""


HCHARS0 = HCHARS.replace("CAST(CASE WHEN", "CAST(CASE WHEN (unicode(chr) + char_idx) % 7 = 3 THEN 0 WHEN")


def gold_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_idx, word_idx, raw, morph_list, and pred, a flawed copy of it, of the documents in syllables."""
    each = doc_lines(spark, sf_dir).withColumn("line", hangul.from_latin(F.col("line")))
    w = each.select("doc_id", "line_idx", F.posexplode(text.words(F.col("line"))).alias("word_idx", "raw"))
    # columns of their own, not expressions that would be written out wherever they are used
    last = F.substring("raw", -1, 1)
    w = w.withColumn("end", F.when(last.isin(".", ",", "?", "!"), last).otherwise(""))
    w = w.withColumn("core", F.when(F.col("end") == "", F.col("raw")).otherwise(F.substring(F.col("raw"), F.lit(1), F.char_length("raw") - 1)))
    core, end = F.col("core"), F.col("end")
    w = w.withColumn("tag", F.when((core >= "0") & (core < ":") & core.rlike("^[0-9]+\\z"), "SN").otherwise("NNG"))
    flawed = F.when((F.col("doc_id") * 31 + F.col("word_idx")) % 7 == 0, "NNP").otherwise(F.col("tag"))

    def morphs(t):
        one = F.struct(core.alias("lex"), t.alias("tag"))
        final = F.struct(end.alias("lex"), F.when(end == ",", "SP").otherwise("SF").alias("tag"))
        return F.when(end == "", F.array(one)).when(core == "", F.array(final)).otherwise(F.array(one, final))

    return w.select("doc_id", "line_idx", "word_idx", "raw", morphs(F.col("tag")).alias("morph_list"), morphs(flawed).alias("pred"))


GOLD = rf"""{LINES},
gw AS (SELECT doc_id, line_idx, unnest(p) AS raw, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS word_idx
  FROM (SELECT doc_id, line_idx, regexp_extract_all({HANGUL_SQL.format('line')}, '{NSP}+') AS p FROM lines)),
gc AS (SELECT *, regexp_replace(raw, '[.,?!]$', '') AS core FROM gw),
ge AS (SELECT *, substr(raw, length(core) + 1, 1) AS fin, CASE WHEN regexp_matches(core, '^[0-9]+$') THEN 'SN' ELSE 'NNG' END AS t FROM gc),
gp AS (SELECT *, CASE WHEN (doc_id * 31 + word_idx) % 7 = 0 THEN 'NNP' ELSE t END AS pt, CASE WHEN fin = ',' THEN ',/SP' WHEN fin <> '' THEN fin || '/SF' END AS fm FROM ge),
gold AS (SELECT doc_id, line_idx, word_idx, raw, core, fin,
  list_filter([CASE WHEN core <> '' THEN core || '/' || t END, fm], lambda x: x IS NOT NULL) AS gm,
  list_filter([CASE WHEN core <> '' THEN core || '/' || pt END, fm], lambda x: x IS NOT NULL) AS pm FROM gp)"""


def texts_of(morphs: str):
    """A morpheme array as an array of lex/TAG."""
    return F.transform(morphs, lambda m: F.concat_ws("/", m["lex"], m["tag"]))
