"""Queries of the text core: words, offsets, vocabularies, jamo, packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import hangul, tags, text
from ..operators import vocab
from .base import HCHARS, HWORDS, LINES, NSP, SP, WORD, WORDS, doc_lines, documents, hangul_chars, hangul_words, load, query
from .fixtures import HANGUL_SQL


@query(f"WITH {LINES}, {WORDS} SELECT doc_id, line_idx, word_idx, lex, c_begin, CAST(length(lex) AS INTEGER) AS c_len, b_begin, CAST(strlen(lex) AS INTEGER) AS b_len FROM words")
def tokenize_words(spark, sf_dir):
    """Words of each line with character and byte offsets."""
    return text.tokenize(doc_lines(spark, sf_dir), "line", "doc_id", "line_idx")


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}\x{1c}-\x{1f}]+')) AS lex FROM documents) SELECT doc_id, count(*) AS n_words, CAST(sum(length(lex)) AS BIGINT) AS n_chars FROM w GROUP BY doc_id")
def trainer_words(spark, sf_dir):
    """Words by the wider set of white space that training data uses."""
    w = load(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"), trainer=True)).alias("lex"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.char_length("lex")).cast("long").alias("n_chars"))


def word_places(lines, line: str):
    """lines with the byte offsets of their words as arrays."""
    from ..functions.scan import Scan, as_lists
    from ..operators.batches import with_columns

    def fn(cols):
        w = Scan([t or "" for t in cols[0]]).words()
        sizes = np.bincount(w["owner"], minlength=len(cols[0]))
        return [as_lists(w["b_begin"], sizes), as_lists(w["b_begin"] + w["b_len"], sizes)]

    return with_columns(lines, [line], fn, "b_begin array<int>, b_end array<int>")


_CHARS = "CAST(i - 1 AS INTEGER) AS char_idx, chr, CAST(sum(strlen(chr)) OVER w - strlen(chr) AS INTEGER) AS b_begin, CAST(sum(strlen(chr)) OVER w AS INTEGER) AS b_end FROM c WINDOW w AS"


@query(f"WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS chr, generate_subscripts(string_split(text, ''), 1) AS i FROM documents) SELECT doc_id, {_CHARS} (PARTITION BY doc_id ORDER BY i)")
def char_offsets(spark, sf_dir):
    """B2: characters with byte begin and end."""
    return text.char_table(documents(spark, sf_dir), "text", "doc_id")


@query(f"WITH c AS (SELECT item_id, unnest(string_split(t, '')) AS chr, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT item_id, substr(text, 1, CAST(item_id % 97 + 5 AS INTEGER)) AS t FROM benchmark)) SELECT item_id, {_CHARS} (PARTITION BY item_id ORDER BY i)")
def char_offsets_until_nul(spark, sf_dir):
    """B2: nothing after a NUL counts."""
    cut = (F.col("item_id") % 97 + 5).cast("int")
    t = F.concat(F.substring("text", F.lit(1), cut), F.lit("\0"), F.substring("text", cut + 1, F.char_length("text")), F.lit("\0 end"))
    return text.char_table(load(spark, sf_dir, "benchmark").select("item_id", t.alias("text")), "text", "item_id")


@query(rf"WITH b AS (SELECT item_id, substr(text, 1, CAST(item_id % 97 + 5 AS INTEGER)) AS t FROM benchmark), w AS (SELECT item_id, unnest(regexp_extract_all(t, '{NSP}+')) AS lex, generate_subscripts(regexp_extract_all(t, '{NSP}+'), 1) AS i FROM b) SELECT item_id, CAST(i - 1 AS INTEGER) AS word_idx, lex FROM w")
def tokenize_until_nul(spark, sf_dir):
    """Words before a NUL."""
    cut = (F.col("item_id") % 97 + 5).cast("int")
    t = F.concat(F.substring("text", F.lit(1), cut), F.lit("\0"), F.substring("text", cut + 1, F.char_length("text")))
    return text.tokenize(load(spark, sf_dir, "benchmark").select("item_id", t.alias("text")), "text", "item_id").select("item_id", "word_idx", "lex")


@query(f"WITH {LINES}, {WORDS} SELECT doc_id, line_idx, word_idx, b_begin, CAST(length(lex) AS INTEGER) AS c_len, c_begin, c_begin + CAST(length(lex) AS INTEGER) AS c_end FROM words")
def byte_to_char(spark, sf_dir):
    """Character offsets found from byte offsets."""
    nested = word_places(doc_lines(spark, sf_dir), "line")
    at = text.byte_to_char(nested, "line", "b_begin", "c_begin", b_end="c_end")
    each = at.select("doc_id", "line_idx", F.posexplode(F.arrays_zip("b_begin", "c_begin", "c_end")).alias("word_idx", "w")).select("doc_id", "line_idx", "word_idx", "w.*")
    return each.withColumn("c_len", F.col("c_end") - F.col("c_begin"))


_VOCAB = r"vocab AS (SELECT CAST(row_number() OVER (ORDER BY encode(chr)) + 3 AS INTEGER) AS id, chr, freq FROM (SELECT chr, count(*) AS freq FROM (SELECT unnest(string_split(text, '')) AS chr FROM documents) WHERE NOT regexp_matches(chr, '^[ \t\x0b\r\n\x{3000}]$') GROUP BY chr) WHERE freq >= 2)"


@query(f"WITH {_VOCAB} SELECT id, chr, freq FROM vocab")
def char_vocab(spark, sf_dir):
    """D-1, B16, B17, F1, A9, A22: the character vocabulary."""
    return vocab.with_ids(vocab.char_counts(load(spark, sf_dir, "documents"), "text"))


@query(f"WITH {_VOCAB}, c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS chr, generate_subscripts(string_split(p_name, ''), 1) AS i FROM part) SELECT p_partkey, CAST(i - 1 AS INTEGER) AS char_idx, chr, coalesce(id, 1) AS id FROM c LEFT JOIN vocab USING (chr)")
def char_ids(spark, sf_dir):
    """Characters looked up in the vocabulary, 1 where unknown."""
    v = vocab.with_ids(vocab.char_counts(load(spark, sf_dir, "documents"), "text"))
    c = load(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.chars(F.col("p_name"))).alias("char_idx", "chr"))
    return vocab.look_up(c, v).select("p_partkey", "char_idx", "chr", "id")


_JAMO = f"(CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN substr('{hangul.FIRST}', CAST((unicode(c) - 44032) // 588 + 1 AS INTEGER), 1) || substr('{hangul.MIDDLE}', CAST(((unicode(c) - 44032) % 588) // 28 + 1 AS INTEGER), 1) || CASE WHEN (unicode(c) - 44032) % 28 > 0 THEN substr('{hangul.LAST}', CAST((unicode(c) - 44032) % 28 AS INTEGER), 1) ELSE '' END ELSE c END)"


@query(f"WITH {HWORDS}, k AS (SELECT conv_id, turn, line_idx, word_idx, word || chr(CAST(44032 + (conv_id * 7919 + turn * 131 + line_idx * 17 + word_idx) % 11172 AS INTEGER)) AS word FROM hwords) SELECT conv_id, turn, line_idx, word_idx, word, list_aggregate(list_transform(string_split(word, ''), lambda c: {_JAMO}), 'string_agg', '') AS jamo FROM k")
def jamo_decompose(spark, sf_dir):
    """H1, H8: syllables as jamo; one syllable of any of the 11,172 is added to each word."""
    w = hangul_words(spark, sf_dir)
    code = 44032 + (F.col("conv_id") * 7919 + F.col("turn") * 131 + F.col("line_idx") * 17 + F.col("word_idx")) % 11172
    any_syllable = F.decode(F.unhex(F.hex(code)), "UTF-16BE")
    w = w.withColumn("word", F.concat("word", any_syllable))
    return w.select(*WORD, "word", hangul.decompose(F.col("word")).alias("jamo"))


_N = len(hangul.OTHER_JAMO)


@query(f"WITH j AS (SELECT p_partkey, p_name || substr('{hangul.OTHER_JAMO}', CAST(p_partkey % {_N} + 1 AS INTEGER), 1) || substr('{hangul.ARCHAIC}', CAST(p_partkey % 2 + 1 AS INTEGER), 1) AS jamo FROM part) SELECT p_partkey, jamo, translate(translate(jamo, '{hangul.ARCHAIC}', '{hangul.ARCHAIC_COMPAT}'), '{hangul.OTHER_JAMO}', '{hangul.COMPAT_JAMO}') AS compat FROM j")
def jamo_normalize(spark, sf_dir):
    """H2, H3: conjoining, halfwidth and archaic jamo as compatibility jamo."""
    j = F.concat("p_name", F.substring(F.lit(hangul.OTHER_JAMO), (F.col("p_partkey") % _N + 1).cast("int"), F.lit(1)), F.substring(F.lit(hangul.ARCHAIC), (F.col("p_partkey") % 2 + 1).cast("int"), F.lit(1)))
    p = load(spark, sf_dir, "part").select("p_partkey", j.alias("jamo"))
    return p.select("p_partkey", "jamo", hangul.to_compat(hangul.fix_archaic(F.col("jamo"))).alias("compat"))


@query(f"WITH {HWORDS}, {HCHARS} SELECT conv_id, turn, line_idx, word_idx, char_idx, chr, tag_out, CAST(unicode(chr) AS BIGINT) * 4096 + tag_out AS packed FROM hchars")
def pack_char_tags(spark, sf_dir):
    """The packed key of a character and its tag."""
    c = hangul_chars(spark, sf_dir)
    return c.select(*WORD, "char_idx", "chr", "tag_out", tags.pack(F.col("chr"), F.col("tag_out")).alias("packed"))


@query("SELECT p_partkey, CASE WHEN i = 0 OR i = n + 1 THEN -2 WHEN c = ' ' THEN -1 ELSE CAST(unicode(c) AS BIGINT) * 4096 + (unicode(c) + i) % 92 + 1 END AS mixed, CAST(i AS INTEGER) AS pos FROM (SELECT p_partkey, length(p_name) AS n, i, CASE WHEN i BETWEEN 1 AND length(p_name) THEN substr(p_name, CAST(i AS INTEGER), 1) END AS c FROM part, LATERAL (SELECT unnest(range(0, length(p_name) + 2)) AS i))")
def mix_char_tag(spark, sf_dir):
    """H5: characters and tags of a text as packed integers; spaces and ends become delimiters."""
    p = load(spark, sf_dir, "part").withColumn("cs", F.split("p_name", ""))
    own = F.transform("cs", lambda c, i: F.when(c == " ", -1).otherwise((F.ascii(c) + i + 1) % 92 + 1))
    t = F.concat(F.array(F.lit(-2)), own, F.array(F.lit(-2)))
    return p.select("p_partkey", F.posexplode(tags.mix_char_tag(F.col("cs"), t)).alias("pos", "mixed"))


@query(f"WITH {HWORDS}, {HCHARS}, t(num, tag) AS (VALUES {', '.join(f'({i}, {chr(39)}{t}{chr(39)})' for i, t in enumerate(tags.TAGS, 1))}) SELECT tag_out, tag, CASE WHEN tag_out > 46 THEN 1 ELSE 0 END AS bi, count(*) AS n, tag_out > 92 AS composite FROM hchars LEFT JOIN t ON tag_out <= 92 AND (tag_out - 1) % 46 + 1 = num GROUP BY ALL")
def unpack_tags(spark, sf_dir):
    """Output tags as simple tags and B/I."""
    c = hangul_chars(spark, sf_dir)
    t, many = F.col("tag_out"), tags.needs_restore(F.col("tag_out"))
    return c.groupBy("tag_out", F.when(~many, tags.tag_name(tags.simple_tag(t).cast("int"))).alias("tag"), tags.is_inside(t).alias("bi"), many.alias("composite")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[0-9]', '0', 'g')) AS masked FROM documents WHERE regexp_matches(text, '[0-9]')")
def mask_digits(spark, sf_dir):
    """Digits made alike."""
    d = load(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    return d.select("doc_id", F.md5(text.mask_digits(F.col("text"))).alias("masked"))


@query("SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, f AS field FROM (SELECT p_partkey, unnest(fs) AS f, generate_subscripts(fs, 1) AS i FROM (SELECT p_partkey, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS fs FROM (SELECT p_partkey, string_split(replace(p_type, ' ', '|') || CASE WHEN p_partkey % 2 = 0 THEN '|' ELSE '' END, '|') AS x FROM part)))")
def split_fields(spark, sf_dir):
    """H9: fields of a line; one empty field at the end is dropped."""
    line = F.concat(F.translate("p_type", " ", "|"), F.when(F.col("p_partkey") % 2 == 0, "|").otherwise(""))
    return load(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.split_trailing(line, "|")).alias("pos", "field"))


@query(rf"SELECT conv_id, turn, CAST(length(regexp_replace(text, '{SP}+', '', 'g')) + len(regexp_extract_all(text, '{NSP}+')) + 1 AS INTEGER) AS n FROM conversations")
def sequence_length(spark, sf_dir):
    """Characters and boundaries of a text."""
    n = F.char_length(F.regexp_replace("text", f"[{text.SPACES}]+", "")) + F.size(text.words(F.col("text"))) + 1
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"))


_H = HANGUL_SQL


@query(f"SELECT count(*) AS n_docs, CAST(sum(length({_H.format('text')})) AS BIGINT) AS n_chars FROM documents")
def hangul_synthesis(spark, sf_dir):
    """The Hangul text that other queries run on, as a sum."""
    return load(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.char_length(hangul.from_latin(F.col("text")))).cast("long").alias("n_chars"))
