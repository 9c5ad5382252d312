"""The analyzer end to end, with a small network whose parameters are plain arithmetic, so that SQL can repeat every stage."""

from __future__ import annotations

import functools
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..analyzer import Analyzer
from ..functions import text
from ..functions.hangul import SYLLABLES
from ..operators import tagger
from ..operators.resources import KERNELS, Model
from . import fixtures as X
from .analysis_queries import _MORPHS, _RESTORED, _REVISED, _S, _W
from .base import HWORDS, NSP, SENT, SP, query, turns
from .fixtures import HANGUL_SQL

WINDOW, EMBED, HIDDEN, CLASSES, SEED = 2, 6, 10, 97, 17
VOCAB = "".join(sorted(set(SYLLABLES)))


def parameter(i: np.ndarray) -> np.ndarray:
    """The i-th parameter of the network: of zero mean, by integer arithmetic."""
    x = (i.astype(np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return ((x % np.uint64(20011)).astype(np.int64) - 10005) / 8192


@functools.lru_cache(1)
def model() -> Model:
    """A network that tells many characters apart: its biases centre the outputs of each layer over a fixed text."""
    m = Model.made(WINDOW, EMBED, HIDDEN, CLASSES, VOCAB, parameter, np.float64)
    text = [[VOCAB[(7 * i + k) % len(VOCAB)] * (1 + i % 3) + VOCAB[(i * i + 3 * k) % len(VOCAB)] for k in range(5)] for i in range(60)]
    layout = tagger.Layout(text, WINDOW)
    f = tagger.pooled(m, tagger.windows(m, layout, np.arange(len(layout.text))))
    m = replace(m, hidden=(m.hidden[0], np.round(-f.mean(0) @ m.hidden[0], 4)))
    h = tagger.hidden(m, f)
    return replace(m, out=(m.out[0], np.round(-h.mean(0) @ m.out[0], 4)))


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in np.ravel(values)) + "]"


def cnn_sql() -> str:
    """Tables vec(id, e), win (the input of each character) and cnn (its tag), over hchar (sentence, word, char_idx, chr)."""
    m, length = model(), 2 * WINDOW + 1
    vec = ", ".join(f"({i}, {_list(m.embed[i])})" for i in range(len(m.embed)))
    pe = np.array([[1 - p / length - i / EMBED * (1 - 2 * p / length) for i in range(1, EMBED + 1)] for p in range(1, length + 1)])
    zero = _list(np.zeros(EMBED))
    cells = []
    for p in range(length):
        d = p - WINDOW
        own = "e" if d == 0 else f"coalesce({'lag' if d < 0 else 'lead'}(e, {abs(d)}) OVER w, {zero})"
        left = f"CASE WHEN {WINDOW} - char_idx = {p} THEN {_list(m.embed[2])} ELSE {zero} END"
        right = f"CASE WHEN {WINDOW} + length(word) - char_idx - 1 = {p} THEN {_list(m.embed[3])} ELSE {zero} END"
        cells.append(f"list_transform(list_zip({own}, {left}, {right}, {_list(pe[p])}), lambda x: x[1] + x[2] + x[3] + x[4])")
    features = []
    for k in KERNELS:
        weight, bias = m.filters[k]
        for f in range(EMBED):
            dots = [f"list_dot_product(x[{EMBED * r + 1}:{EMBED * (r + k)}], {_list(weight[:, f])})" for r in range(length - k + 1)]
            features.append(f"greatest(0.0, greatest({', '.join(dots)}) + {float(bias[f])!r})")
    hidden = [f"greatest(0.0, list_dot_product(f, {_list(m.hidden[0][:, h])}) + {float(m.hidden[1][h])!r})" for h in range(HIDDEN)]
    out = [f"list_dot_product(h, {_list(m.out[0][:, c])}) + {float(m.out[1][c])!r}" for c in range(CLASSES)]
    return f"""vec(id, e) AS (VALUES {vec}),
hchar AS (SELECT *, unnest(string_split(word, '')) AS chr, CAST(generate_subscripts(string_split(word, ''), 1) - 1 AS INTEGER) AS char_idx FROM hwords),
emb AS (SELECT h.*, e FROM hchar h JOIN vec ON id = CASE WHEN strpos('{VOCAB}', chr) > 0 THEN strpos('{VOCAB}', chr) + 3 ELSE 1 END),
win AS (SELECT {_W}, word, char_idx, chr, flatten([{', '.join(cells)}]) AS x FROM emb WINDOW w AS (PARTITION BY {_S} ORDER BY word_idx, char_idx)),
feat AS (SELECT * EXCLUDE (x), [{', '.join(features)}] AS f FROM win),
hid AS (SELECT * EXCLUDE (f), [{', '.join(hidden)}] AS h FROM feat),
logit AS (SELECT * EXCLUDE (h), [{', '.join(out)}] AS l FROM hid),
cnn AS (SELECT * EXCLUDE (l), CAST(list_position(l, list_max(l)) AS INTEGER) AS tag FROM logit)"""


#: Places of the words in the lines as they are.
_PLACES = rf"""hp AS (SELECT conv_id, turn, line_idx, unnest(p) AS piece, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS word_idx FROM (SELECT *, regexp_extract_all(line, '{SP}*{NSP}+') AS p FROM tl2)),
place AS (SELECT conv_id, turn, line_idx, word_idx, regexp_extract(piece, '{NSP}+') AS pw, CAST(sum(length(piece)) OVER s - length(regexp_extract(piece, '{NSP}+')) AS INTEGER) AS c,
  CAST(sum(strlen(piece)) OVER s - strlen(regexp_extract(piece, '{NSP}+')) AS INTEGER) AS b FROM hp WINDOW s AS (PARTITION BY conv_id, turn, line_idx ORDER BY word_idx))"""
_KNOWN = f"""{X.PREANAL_SQL}, pre AS (SELECT word AS w, arg_max(tag_nums, length(key)) AS ts FROM (SELECT DISTINCT word FROM hwords) d JOIN preanal ON starts_with(word, key) AND (is_pfx OR key = word) GROUP BY word),
hchars AS (SELECT {_W}, word, char_idx, chr, CAST(CASE WHEN coalesce(ts[char_idx + 1], 0) > 0 THEN ts[char_idx + 1] ELSE tag END AS INTEGER) AS tag_out FROM cnn LEFT JOIN pre ON word = w)"""
_TAGS = f"""wt AS (SELECT {_W}, list(tag_out ORDER BY char_idx) AS ts, list(CAST(unicode(chr) AS BIGINT) * 4096 + tag_out ORDER BY char_idx) AS ms FROM revised GROUP BY {_W}),
st AS (SELECT {_S}, list_concat([-2], flatten(list(CASE WHEN word_idx > 0 THEN list_concat([-1], ts) ELSE ts END ORDER BY word_idx)), [-2]) AS tags,
  list_concat([-2], flatten(list(CASE WHEN word_idx > 0 THEN list_concat([-1], ms) ELSE ms END ORDER BY word_idx)), [-2]) AS mix FROM wt GROUP BY {_S})"""
_OUT = f"""SELECT m.*, c + first_char AS c_begin, last_char - first_char + 1 AS c_len, b + CAST(strlen(substr(pw, 1, first_char)) AS INTEGER) AS b_begin,
  CAST(strlen(substr(pw, first_char + 1, last_char - first_char + 1)) AS INTEGER) AS b_len FROM morphs m JOIN place USING ({_W})"""


def lines(spark, sf_dir):
    return text.lines(turns(spark, sf_dir), "text", "conv_id", "turn")


def analyzer(**options) -> Analyzer:
    return Analyzer(model(), X.DICTIONARIES, **options)


def _flat(df):
    w = df.select(*SENT, F.posexplode("words").alias("word_idx", "w")).select(*SENT, "word_idx", F.col("w.c_begin").alias("at"), F.posexplode("w.morphs").alias("morph_idx", "m"))
    first = F.col("m.c_begin") - F.col("at")
    return w.select(*SENT, "word_idx", "morph_idx", "m.lex", "m.tag", first.alias("first_char"), (first + F.col("m.c_len") - 1).alias("last_char"), "m.c_begin", "m.c_len", "m.b_begin", "m.b_len")


_FULL = f"WITH {HWORDS}, {cnn_sql()}, {_KNOWN}, {_REVISED}"


@query(f"WITH {HWORDS}, {cnn_sql()} SELECT {_W}, char_idx, tag FROM cnn")
def cnn_tags(spark, sf_dir):
    """I1, I2, I4, I5, I6, D-13, D-14: the network's tag of each character."""
    from ..operators.analyzer import char_rows
    from ..operators.batches import with_columns
    from ..operators.tagger import predict

    m = model()
    s = lines(spark, sf_dir).select(*SENT, text.words(F.col("line")).alias("words"))
    tagged = with_columns(s, ["words"], lambda cols: [predict(m, cols[0], [[[0] * len(w) for w in ws] for ws in cols[0]])], "tags array<array<int>>")
    return char_rows(tagged, SENT, "tags").select(*SENT, "word_idx", "char_idx", F.col("tags").alias("tag"))


@query(f"{_FULL}, {_RESTORED.replace('{src}', 'revised')}, {_MORPHS}, {_PLACES} {_OUT}")
def analyze_words(spark, sf_dir):
    """Words, dictionary, network, revision, restoration, morphemes and offsets, without error patches."""
    return _flat(analyzer(errpatch=False).analyze(lines(spark, sf_dir), "line"))


_PATCHED = f"""{X.PATCHES_SQL}, spots AS (SELECT {_S}, mix, unnest(mix) AS k, generate_subscripts(mix, 1) - 1 AS pos FROM st),
best AS (SELECT {_S}, pos, max(n) AS n, arg_max(r, n) AS r FROM spots JOIN pat USING (k) WHERE mix[pos + 1:pos + n] = l GROUP BY {_S}, pos),
walk AS (SELECT {_S}, min(pos) AS pos, min_by(n, pos) AS n, min_by(r, pos) AS r FROM best GROUP BY {_S}
  UNION ALL
  SELECT w.conv_id, w.turn, w.line_idx, x.pos, x.n, x.r FROM walk w, LATERAL (SELECT b.pos, b.n, b.r FROM best b WHERE b.conv_id = w.conv_id AND b.turn = w.turn AND b.line_idx = w.line_idx AND b.pos >= w.pos + w.n ORDER BY b.pos LIMIT 1) x),
cells AS (SELECT {_S}, pos + i AS p, r[i + 1] AS t FROM (SELECT *, unnest(range(n)) AS i FROM walk)),
seq AS (SELECT {_W}, word, char_idx, chr, tag_out, row_number() OVER (PARTITION BY {_S} ORDER BY word_idx, char_idx) + word_idx AS p FROM revised),
patched AS (SELECT {_W}, word, char_idx, chr, CAST(coalesce(t, tag_out) AS INTEGER) AS tag_out FROM seq LEFT JOIN cells USING (conv_id, turn, line_idx, p))"""


@query(f"WITH RECURSIVE {_FULL.removeprefix('WITH ')}, {_TAGS}, {_PATCHED}, {_RESTORED.replace('{src}', 'patched')}, {_MORPHS}, {_PLACES} {_OUT}")
def analyze_patched(spark, sf_dir):
    """All stages with all dictionaries."""
    return _flat(analyzer().analyze(lines(spark, sf_dir), "line"))


@query(f"{_FULL}, {X.FIRSTS_SQL.replace('firsts(', 'firsts2(')}, {_RESTORED.replace('{src}', 'revised').replace('vals IS NOT NULL', 'false')}, {_MORPHS}, {_PLACES} {_OUT}")
def analyze_without_restoring(spark, sf_dir):
    """Options as a JSON object: composites become their first tags."""
    return _flat(analyzer().analyze(lines(spark, sf_dir), "line", '{"restore": false, "errpatch": false, "unknown": 3}'))


@query(f"{_FULL}, {_TAGS}, every AS (SELECT conv_id, turn, line_idx FROM tl2) SELECT {_S}, coalesce(array_to_string(tags, ' '), '-2') AS tags FROM every LEFT JOIN st USING ({_S})")
def analyze_before_patch(spark, sf_dir):
    """Tags before error patches, of blank lines too."""
    out = analyzer().tags_before_patch(lines(spark, sf_dir), "line")
    return out.select(*SENT, F.array_join("tags", " ").alias("tags"))
