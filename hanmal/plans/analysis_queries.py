"""Queries of the analyzer's stages, on the conversations in syllables with made-up tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags
from ..operators import analyzer, dictionary
from . import fixtures as X
from .base import HCHARS, HCHARS0, HWORDS, SENT, WORD, hangul_chars, hangul_sentences, hangul_words, query

_W, _S = "conv_id, turn, line_idx, word_idx", "conv_id, turn, line_idx"


@query(f"WITH {HWORDS}, {X.PREANAL_SQL}, d AS (SELECT DISTINCT word FROM hwords) SELECT word, key, CAST(length(key) AS INTEGER) AS key_len, is_pfx FROM d JOIN preanal ON starts_with(word, key)")
def common_prefixes(spark, sf_dir):
    """C4: all dictionary entries that are a prefix of a word."""
    d = hangul_words(spark, sf_dir).select("word").distinct()
    return dictionary.common_prefixes(d, "word", X.preanal_frame(spark)).select("word", "key", "key_len", "is_pfx")


@query(f"WITH {HWORDS}, {X.PREANAL_SQL}, d AS (SELECT DISTINCT word FROM hwords) SELECT word, arg_max(key, length(key)) AS key, CAST(max(length(key)) AS INTEGER) AS key_len FROM d JOIN preanal ON starts_with(word, key) GROUP BY word")
def longest_prefix(spark, sf_dir):
    """The longest of them."""
    d = hangul_words(spark, sf_dir).select("word").distinct()
    return dictionary.longest_prefix(d, "word", X.preanal_frame(spark), []).select("word", "key", "key_len")


@query(f"""WITH {HWORDS}, {X.PREANAL_SQL}, b AS (SELECT word, arg_max(tag_nums, length(key)) AS t FROM (SELECT DISTINCT word FROM hwords) d JOIN preanal ON starts_with(word, key) AND (is_pfx OR key = word) GROUP BY word)
SELECT {_W}, word, array_to_string(list_concat(coalesce(t, []), list_transform(range(length(word) - len(coalesce(t, []))), lambda x: 0)), ' ') AS tag_nums FROM hwords LEFT JOIN b USING (word)""")
def preanal_apply(spark, sf_dir):
    """Tags of the longest acceptable entry, 0 elsewhere; the dictionary is in the workers."""
    out = analyzer.apply_preanal(hangul_sentences(spark, sf_dir), X.DICTIONARIES)
    w = out.select(*SENT, F.posexplode(F.arrays_zip("words", "tags")).alias("word_idx", "w"))
    return w.select(*WORD, F.col("w.words").alias("word"), F.array_join("w.tags", " ").alias("tag_nums"))


@query(f"""WITH {HWORDS}, {X.PREANAL_SQL}, b AS (SELECT word, arg_max(tag_nums, length(key)) AS t FROM (SELECT DISTINCT word FROM hwords) d JOIN preanal ON starts_with(word, key) AND (is_pfx OR key = word) GROUP BY word)
SELECT {_W}, word, array_to_string(list_concat(coalesce(t, []), list_transform(range(length(word) - len(coalesce(t, []))), lambda x: 0)), ' ') AS tag_nums FROM hwords LEFT JOIN b USING (word)""")
def preanal_join(spark, sf_dir):
    """The same by joins, for a dictionary too large for the workers."""
    out = dictionary.apply_preanal(hangul_words(spark, sf_dir), "word", X.preanal_frame(spark))
    return out.select(*WORD, "word", F.array_join("tag_nums", " ").alias("tag_nums"))


_LAST = f"{X.RESTORE_SQL}, {X.FIRSTS_SQL}, known AS (SELECT chr, tag_out, vals[-1].tag AS last FROM restore)"
_REVISED = f"""{_LAST},
ra AS (SELECT h.*, CASE WHEN h.tag_out > 92 AND last IS NULL THEN first_tag ELSE h.tag_out END AS t1, last FROM hchars h LEFT JOIN known USING (chr, tag_out) LEFT JOIN firsts USING (tag_out)),
rb AS (SELECT *, CASE WHEN t1 = 0 THEN 0 WHEN t1 > 92 THEN last ELSE (t1 - 1) % 46 + 1 END AS cat FROM ra),
revised AS (SELECT {_W}, word, char_idx, chr, CAST(CASE WHEN t1 BETWEEN 1 AND 46 AND lag(cat) OVER w IS DISTINCT FROM cat THEN t1 + 46 ELSE t1 END AS INTEGER) AS tag_out FROM rb WINDOW w AS (PARTITION BY {_W} ORDER BY char_idx))"""


@query(f"WITH {HWORDS}, {HCHARS0}, {_REVISED} SELECT {_W}, char_idx, chr, tag_out FROM revised")
def revise_tags(spark, sf_dir):
    """O3, E5: impossible composites and B- tags revised; characters without a tag stay so."""
    out = analyzer.revise_tags(hangul_sentences(spark, sf_dir, zeros=True), X.DICTIONARIES)
    return analyzer.char_rows(out, SENT, "tags").select(*WORD, "char_idx", "chr", F.col("tags").alias("tag_out"))


_RESTORED = "restored AS (SELECT r.*, CASE WHEN r.tag_out <= 92 THEN [{'chr': r.chr, 'tag': (r.tag_out - 1) % 46 + 1, 'bi': CASE WHEN r.tag_out > 46 THEN 1 ELSE 0 END}] WHEN vals IS NOT NULL THEN vals ELSE [{'chr': r.chr, 'tag': (first_tag - 1) % 46 + 1, 'bi': CASE WHEN first_tag > 46 THEN 1 ELSE 0 END}] END AS rs, r.tag_out > 92 AND vals IS NULL AS missing FROM {src} r LEFT JOIN restore USING (chr, tag_out) LEFT JOIN firsts USING (tag_out))"


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: F.concat_ws("/", x["chr"], x["tag"], x["bi"])), " ")


@query(f"WITH {HWORDS}, {HCHARS}, {X.RESTORE_SQL}, {X.FIRSTS_SQL}, {_RESTORED.replace('{src}', 'hchars')} SELECT {_W}, char_idx, missing, array_to_string(list_transform(rs, lambda x: x.chr || '/' || x.tag || '/' || x.bi), ' ') AS restored FROM restored")
def restore_chars(spark, sf_dir):
    """Restored characters; composites that the dictionary lacks get their first tag."""
    out = analyzer.restore(hangul_sentences(spark, sf_dir), X.DICTIONARIES)
    return analyzer.char_rows(out, SENT, "restored", "missing").select(*WORD, "char_idx", "missing", _text("restored").alias("restored"))


@query(f"WITH {HWORDS}, {HCHARS}, {X.FIRSTS_SQL}, f AS (SELECT h.*, CASE WHEN h.tag_out > 92 THEN first_tag ELSE h.tag_out END AS t FROM hchars h LEFT JOIN firsts USING (tag_out)) SELECT {_W}, char_idx, chr || '/' || ((t - 1) % 46 + 1) || '/' || CASE WHEN t > 46 THEN 1 ELSE 0 END AS restored FROM f")
def restore_off(spark, sf_dir):
    """Without the dictionary every composite becomes its first tag."""
    out = analyzer.restore(hangul_sentences(spark, sf_dir), X.DICTIONARIES, use_dic=False)
    return analyzer.char_rows(out, SENT, "restored").select(*WORD, "char_idx", _text("restored").alias("restored"))


_MORPHS = f"""mflat AS (SELECT {_W}, char_idx, unnest(rs) AS x, generate_subscripts(rs, 1) AS k FROM restored),
mst AS (SELECT *, CASE WHEN x.bi = 1 AND lag(x.tag) OVER w = x.tag THEN 0 ELSE 1 END AS st FROM mflat WINDOW w AS (PARTITION BY {_W} ORDER BY char_idx, k)),
mrun AS (SELECT *, sum(st) OVER (PARTITION BY {_W} ORDER BY char_idx, k) - 1 AS morph_idx FROM mst),
tn(num, tag) AS (VALUES {', '.join(f'({i}, {chr(39)}{t}{chr(39)})' for i, t in enumerate(tags.TAGS, 1))}),
morphs AS (SELECT {_W}, CAST(morph_idx AS INTEGER) AS morph_idx, string_agg(x.chr, '' ORDER BY char_idx, k) AS lex, min(tag) AS tag, min(char_idx) AS first_char, max(char_idx) AS last_char FROM mrun JOIN tn ON num = x.tag GROUP BY {_W}, morph_idx)"""


def _morphs(spark, sf_dir):
    revised = analyzer.revise_tags(hangul_sentences(spark, sf_dir), X.DICTIONARIES)
    return analyzer.make_morphs(revised, X.DICTIONARIES)


_CHAIN = f"WITH {HWORDS}, {HCHARS}, {_REVISED}, {_RESTORED.replace('{src}', 'revised')}, {_MORPHS}"


@query(f"{_CHAIN} SELECT * FROM morphs")
def make_morphs(spark, sf_dir):
    """Morphemes with the characters they come from."""
    return analyzer.morph_rows(_morphs(spark, sf_dir), SENT).drop("word")


@query(f"""{_CHAIN}, hw2 AS (SELECT h.*, CAST(sum(length(word) + 1) OVER s - length(word) - 1 AS INTEGER) AS c, CAST(sum(strlen(word) + 1) OVER s - strlen(word) - 1 AS INTEGER) AS b FROM hwords h WINDOW s AS (PARTITION BY {_S} ORDER BY word_idx))
SELECT m.*, c + first_char AS c_begin, last_char - first_char + 1 AS c_len, b + CAST(strlen(substr(word, 1, first_char)) AS INTEGER) AS b_begin, CAST(strlen(substr(word, first_char + 1, last_char - first_char + 1)) AS INTEGER) AS b_len FROM morphs m JOIN hw2 USING ({_W})""")
def morph_offsets(spark, sf_dir):
    """Character and byte offsets of morphemes, with words set apart by single spaces."""
    m = _morphs(spark, sf_dir)
    before = lambda f: F.transform("words", lambda w, i: F.aggregate(F.slice("words", F.lit(1), i), F.lit(0), lambda a, x: a + f(x) + 1))
    w = m.select(*SENT, F.posexplode(F.arrays_zip("words", "morphs", before(F.char_length).alias("c"), before(F.octet_length).alias("b"))).alias("word_idx", "w"))
    each = w.select(*WORD, "w.*").select(*WORD, "words", "c", "b", F.posexplode("morphs").alias("morph_idx", "m")).select("*", "m.*")
    upto = lambda n: F.octet_length(F.substring(F.col("words"), F.lit(1), n))
    return each.select(
        *WORD, "morph_idx", "lex", "tag", "first_char", "last_char", (F.col("c") + F.col("first_char")).alias("c_begin"), (F.col("last_char") - F.col("first_char") + 1).alias("c_len"),
        (F.col("b") + upto(F.col("first_char"))).alias("b_begin"), (upto(F.col("last_char") + 1) - upto(F.col("first_char"))).alias("b_len"),
    )


@query(f"{_CHAIN} SELECT {_S}, count(*) AS n_morphs, count(DISTINCT word_idx) AS n_words FROM morphs GROUP BY {_S}")
def sentence_morph_count(spark, sf_dir):
    """D-12: morphemes of each sentence."""
    m = _morphs(spark, sf_dir).where(F.size("words") > 0)
    n = F.aggregate(F.transform("morphs", F.size), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select(*SENT, n.alias("n_morphs"), F.size("words").cast("long").alias("n_words"))


_SENT_TAGS = f"""wt AS (SELECT {_W}, list(tag_out ORDER BY char_idx) AS ts, list(CAST(unicode(chr) AS BIGINT) * 4096 + tag_out ORDER BY char_idx) AS ms FROM hchars GROUP BY {_W}),
st AS (SELECT {_S}, list_concat([-2], flatten(list(CASE WHEN word_idx > 0 THEN list_concat([-1], ts) ELSE ts END ORDER BY word_idx)), [-2]) AS tags, list_concat([-2], flatten(list(CASE WHEN word_idx > 0 THEN list_concat([-1], ms) ELSE ms END ORDER BY word_idx)), [-2]) AS mix FROM wt GROUP BY {_S})"""


@query(f"WITH {HWORDS}, {HCHARS}, {_SENT_TAGS} SELECT {_S}, array_to_string(tags, ' ') AS tags FROM st")
def before_patch_tags(spark, sf_dir):
    """Tags of a sentence with delimiters."""
    return hangul_sentences(spark, sf_dir).where(F.size("words") > 0).select(*SENT, F.array_join(analyzer.sentence_tags(F.col("tags")), " ").alias("tags"))


@query(f"""WITH RECURSIVE {HWORDS}, {HCHARS}, {_SENT_TAGS}, {X.PATCHES_SQL},
spots AS (SELECT {_S}, mix, unnest(mix) AS k, generate_subscripts(mix, 1) - 1 AS pos FROM st),
best AS (SELECT {_S}, pos, max(n) AS n, arg_max(r, n) AS r FROM spots JOIN pat USING (k) WHERE mix[pos + 1:pos + n] = l GROUP BY {_S}, pos),
walk AS (SELECT {_S}, min(pos) AS pos, min_by(n, pos) AS n, min_by(r, pos) AS r FROM best GROUP BY {_S}
  UNION ALL
  SELECT w.conv_id, w.turn, w.line_idx, x.pos, x.n, x.r FROM walk w, LATERAL (SELECT b.pos, b.n, b.r FROM best b WHERE b.conv_id = w.conv_id AND b.turn = w.turn AND b.line_idx = w.line_idx AND b.pos >= w.pos + w.n ORDER BY b.pos LIMIT 1) x),
cells AS (SELECT {_S}, pos + i AS p, r[i + 1] AS t FROM (SELECT *, unnest(range(n)) AS i FROM walk)),
tg AS (SELECT {_S}, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS p FROM st)
SELECT {_S}, string_agg(CASE WHEN tag < 0 THEN tag ELSE coalesce(t, tag) END, ' ' ORDER BY p) AS tags FROM tg LEFT JOIN cells USING (conv_id, turn, line_idx, p) GROUP BY {_S}""")
def errpatch_apply(spark, sf_dir):
    """Leftmost-longest patches over the packed characters."""
    out = analyzer.apply_errpatch(hangul_sentences(spark, sf_dir).where(F.size("words") > 0), X.DICTIONARIES)
    return out.select(*SENT, F.array_join(analyzer.sentence_tags(F.col("tags")), " ").alias("tags"))


@query(f"WITH {HWORDS}, {HCHARS}, i AS (SELECT *, unicode(chr) % 1000 AS id FROM hchars) SELECT {_W}, char_idx, concat_ws(' ', {', '.join(f'coalesce({f}(id, {k}) OVER w, 0)' if k else 'id' for f, k in [('lag', 4), ('lag', 3), ('lag', 2), ('lag', 1), ('', 0), ('lead', 1), ('lead', 2), ('lead', 3), ('lead', 4)])}) AS context FROM i WINDOW w AS (PARTITION BY {_S} ORDER BY word_idx, char_idx)")
def context_windows(spark, sf_dir):
    """Four characters on each side, across words."""
    s = hangul_sentences(spark, sf_dir).withColumn("ids", F.transform("words", lambda w: F.transform(F.split(w, ""), lambda c: F.ascii(c) % 1000)))
    c = analyzer.char_rows(analyzer.contexts(s.select(*SENT, "words", "ids"), "ids", 4), SENT, "contexts")
    return c.select(*WORD, "char_idx", F.array_join("contexts", " ").alias("context"))


@query(f"WITH {HWORDS}, {HCHARS} SELECT {_W}, char_idx, CASE WHEN 4 - char_idx >= 0 THEN 4 - char_idx ELSE -1 END AS left_mask, CAST(CASE WHEN 4 + length(word) - char_idx - 1 <= 8 THEN 4 + length(word) - char_idx - 1 ELSE -1 END AS INTEGER) AS right_mask FROM hchars")
def word_bound_masks(spark, sf_dir):
    """Where in the context the word begins and ends."""
    left, right = analyzer.bound_masks(F.col("char_idx"), F.char_length("word"), 4)
    return hangul_chars(spark, sf_dir).select(*WORD, "char_idx", left.alias("left_mask"), right.alias("right_mask"))


@query("SELECT CAST(p AS INTEGER) AS p, CAST(i AS INTEGER) AS i, round(1 - p / 9.0 - i / 35.0 * (1 - 2 * p / 9.0), 6) AS pe FROM range(1, 10) a(p), range(1, 36) b(i)")
def positional_encoding(spark, sf_dir):
    """The encoding of each place and dimension."""
    at = spark.range(1, 10).select(F.col("id").cast("int").alias("p")).crossJoin(spark.range(1, 36).select(F.col("id").cast("int").alias("i")))
    return at.select("p", "i", F.round(analyzer.positional_encoding(F.col("p"), F.col("i"), 9, 35), 6).alias("pe"))
