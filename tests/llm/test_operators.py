"""Each operator against a brute-force version, an exact round trip or held-out labels, and on odd inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanmal.llm import line_dedup, mil_quality, mixing, packing, quality_rules, secret_scan, simhash, substring_dedup, telephony, warc
from hanmal.llm import queries as Q
from hanmal.llm.tokens import VOCABULARY, count_tokens, encoding

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, sig int, key string, rate double, lines int, count int"
LABELS = "doc_id long, quality int, toxic int"
WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti") for b in ("dar", "fel", "gon", "hul", "jim", "kas", "ler", "mov")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", 1, "k", 0.5, 2, 3) for i, t, g, s in rows], COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    long = prose(1, 30_000)
    rows = [(1, prose(2, 80), "en", "a"), (1, prose(2, 80), "en", "a"), (1, prose(3, 80), None, None), (None, prose(2, 80), "en", "a"), (None, None, None, None), (2, "", "de", "b"), (3, None, "fr", "b"), (4, long, "en", "b"), (5, long, "en", "b"), (6, "  \n \n", "en", None)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 0, 0), (None, 1, 0), (4, None, None), (5, 1, 1)], LABELS)


def ids(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


OPERATORS = {
    "mil": mil_quality.apply, "mixing": mixing.apply, "lines": lambda d, _: line_dedup.apply(d), "simhash": lambda d, _: simhash.apply(d), "packing": lambda d, _: packing.apply(d), "secrets": lambda d, _: secret_scan.scan(d),
    "rules": quality_rules.apply, "telephony": lambda d, _: telephony.to_pcm(telephony.clips_of(d), "doc_id"), "repeats": lambda d, _: substring_dedup.repeats(d), "clean": lambda d, _: substring_dedup.clean(d),
}
SAME_COLUMNS = {"mixing", "lines", "simhash", "rules"}
EVERY_ROW = {"mil", "packing", "telephony", "clean", "rules"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, labels, name):
    out = OPERATORS[name](odd, labels)
    assert out.collect() is not None
    if name in SAME_COLUMNS:
        assert out.columns == odd.columns
    if name in EVERY_ROW:
        assert out.count() == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).collect() == []
    assert OPERATORS[name](odd, labels.limit(0)).collect() is not None


def test_odd_rows_defined_results(odd):
    kept = line_dedup.apply(odd)
    assert kept.where("doc_id is null").count() == 2 and kept.where("text = ''").count() == 1
    assert kept.where("doc_id = 5").count() == 0 and kept.where("doc_id = 1").count() == 3
    alone = simhash.apply(odd)
    assert alone.where("doc_id is null").count() == 2 and alone.where("doc_id = 1").count() == 1 and alone.where("doc_id = 5").count() == 0
    assert {(r.doc_id, r.kept_doc_id, r.group_size) for r in simhash.duplicates(odd).collect()} == {(5, 4, 2)}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lines_brute(rows, least=20, short_copies=False):
    at = sorted((i, n, " ".join(x.lower().split())) for i, t in rows for n, x in enumerate(t.split("\n")))
    seen, short = set(), set()
    for i, n, x in at:
        if x and len(x) < least and short_copies and x in seen:
            short.add((i, n))
        seen.add(x)
    at = [x for x in at if len(x[2]) >= least]
    gone = short | {x[:2] for k, x in enumerate(at) if any(abs(len(x[2]) - len(y[2])) < 2 and one_edit(x[2], y[2]) for y in at[:k])}
    out = {}
    for i, t in rows:
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if left == t or left.strip():
            out[i] = left
    return out


def test_line_dedup_brute(spark):
    r = random.Random(4)
    base = [prose(100 + i, 6) for i in range(12)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(4):
            x = r.choice(base) if r.random() < 0.6 else prose(r.random(), 5)
            k = r.randrange(len(x))
            own.append([x, x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "z" + x[k + 1 :], x.upper()][r.randrange(5)])
        rows.append((i, "\n".join([*own, "short"])))
    got = line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.text for x in got.collect()} == lines_brute(rows)


def test_short_line_copies(spark, tmp_path):
    """Exact copies of short lines go in op3, lines one edit apart and blank ones stay."""
    rows = [(1, "and ornd.\n\nles."), (2, "And  ornd.\n\nlet."), (3, "les.\nles.\n\nown"), (4, "les."), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.text for x in Q.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "\nlet.", 3: "\nown", 5: ""}


def components_brute(sigs, most):
    up = {i: i for i in sigs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sigs), 2):
        if (int.from_bytes(sigs[a]) ^ int.from_bytes(sigs[b])).bit_count() <= most:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i in sigs}


def test_simhash_brute(spark):
    r = random.Random(9)
    rows = [(i, prose(500 + i, 120)) for i in range(40)]
    for i in range(40, 160):
        words = rows[r.randrange(40)][1].split()
        for _ in range(r.randrange(8)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        rows.append((i, " ".join(words)))
    brute = components_brute(dict(zip([i for i, _ in rows], simhash.signatures([t for _, t in rows]), strict=True)), simhash.MAX_DISTANCE)
    want = {(i, k) for i, k in brute.items() if i != k}
    got = {(x.doc_id, x.kept_doc_id) for x in simhash.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & want) >= 0.95 * len(want) and len({i for i, _ in got} - {i for i, _ in want}) == 0


def test_substring_planted(spark):
    shared = prose("shared", 70).capitalize() + "."
    texts = [f"{prose(f'{i}a', 50).capitalize()}. {shared if i in (3, 7, 9) else ''} {prose(f'{i}b', 50).capitalize()}." for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.repeats(docs).collect()
    assert {(x.doc_id, x.kept_doc_id) for x in got} == {(7, 3), (9, 3)}
    assert all(texts[x.doc_id][x.begin : x.end] == shared for x in got)
    cleaned = {x.doc_id: x for x in substring_dedup.clean(docs).collect()}
    for i, x in cleaned.items():
        assert (x.text == texts[i]) == (i not in (7, 9))
        if x.kept_spans:
            assert x.text == "\n".join(texts[i][s.begin : s.end].strip() for s in x.kept_spans)


def test_substring_within_sentences(spark):
    """Passages of over 50 words that start and end within a sentence, in lower case, or span lines; one unit of each is whole."""
    r = random.Random("pasted")
    texts = []
    for k, (head, tail, inner) in enumerate([(23, 23, ". {}. "), (40, 3, "\n{}\n"), (2, 600, ". {}. ")]):
        shared = prose(f"{k}head", head) + inner.format(prose(f"{k}unit", 8).capitalize()) + prose(f"{k}tail", tail)
        texts += [(f"{prose(r.random(), 20)} x{2 * k + j}x {shared} y{2 * k + j}y {prose(r.random(), 20)}", shared) for j in range(2)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: (x.kept_doc_id, texts[x.doc_id][0][x.begin : x.end], x.words) for x in substring_dedup.repeats(docs).collect()}
    assert got == {i: (i - 1, texts[i][1], len(texts[i][1].split())) for i in (1, 3, 5)}


def test_optimal_boundaries_brute():
    r = random.Random(3)
    for _ in range(30):
        lengths = sorted(r.sample(range(1, 60), 9))
        counts = [r.randrange(1, 20) for _ in lengths]
        cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
        best = min(cost((*x, lengths[-1])) for x in itertools.combinations(lengths[:-1], 3))
        assert cost(packing.optimal_boundaries(lengths, counts, 4)) == best


def test_packing_batches(spark, sf):
    rows = packing.apply(Q.table(spark, sf, "documents"), 4096, 8).toPandas()
    texts = Q.table(spark, sf, "documents").toPandas().set_index("doc_id")["text"]
    enc = encoding(VOCABULARY)
    assert rows["n_tokens"].tolist() == [len(enc.encode_ordinary(texts[i])) for i in rows["doc_id"]]
    assert len(rows) == len(texts) and not rows.duplicated(["bucket", "batch", "slot"]).any() and (rows["padding"] >= 0).all()
    for (_, _), g in rows.groupby(["bucket", "batch"]):
        assert len(g) == 1 or len(g) * g["bucket_len"].iloc[0] <= 4096
    for _, g in rows.sort_values(["batch", "slot"]).groupby("bucket"):
        assert g["doc_id"].is_monotonic_increasing


@pytest.mark.parametrize("text", ["one two\nthree", " lead", "a  b", "tab\tx", "", "don't stop 123", "x\n\ny"])
def test_token_counts(text):
    assert count_tokens(text) == len(encoding(VOCABULARY).encode_ordinary(text))


def test_binomial_tail():
    for n, k, p in itertools.product((1, 7, 40), (0, 1, 3), (0.01, 0.1, 0.4)):
        if k < n and k <= n * p:
            assert math.isclose(quality_rules.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_quality_rules_risk(spark):
    sf = "/root/testdata/sf0.1"  # a tighter alpha needs more labels than this before anything can be certified
    docs, labels = Q.table(spark, sf, "documents"), Q.table(spark, sf, "labels")
    kept = quality_rules.apply(docs, labels, alpha=0.2).join(labels, "doc_id").groupBy("quality").count().collect()
    total = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    share = {r["quality"]: r["count"] / total[r["quality"]] for r in kept}
    assert share[1] >= 0.8 and share.get(0, 0) < share[1] - 0.1, share


def test_attention_gradients():
    r = np.random.default_rng(1)
    m = mil_quality.Attention(np.arange(3), np.zeros(5), np.ones(5))
    m.start(5, 4, 3)
    x, first, y, w = r.normal(size=(7, 5)), np.array([0, 3, 4]), np.array([1, 0, 1]), np.ones(3)
    loss = lambda: -float((y * np.log(m.forward(x, first)["y"]) + (1 - y) * np.log(1 - m.forward(x, first)["y"])).sum())
    for k, g in m.gradients(x, first, y, w).items():
        at = tuple(0 for _ in g.shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4, k
        m.p[k][at] += 1e-5


def test_attention_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = Q.table(spark, sf, "documents"), Q.table(spark, sf, "labels")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    out = mil_quality.apply(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").toPandas()
    accuracy = [(out[out.quality == q].keep == bool(q)).mean() for q in (0, 1)]
    assert sum(accuracy) / 2 > 0.8, accuracy


def test_mixing_meets_targets(spark):
    out = Q.op2_mixing(spark, "/root/testdata/sf0.01").toPandas()
    got = np.array([(out["n_tokens"] * out["rate"] * out[c]).sum() for c in mixing.P])
    have = np.array([(out["n_tokens"] * out[c]).sum() for c in mixing.P])
    want = have[0] / 0.96 * np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert np.abs(got - want).max() < 2e-4 * want.sum() and (out["unmet"] <= 1e-4).all()
    assert (out["rate"] >= 0).all() and (out["copies"] - out["rate"]).abs().max() < 1


def least_squares(t, p, target, steps=200_000):
    """Nonnegative rates by plain projected gradient steps from 1, in numpy."""
    total, x = target.sum(), np.ones(len(t))
    a = t[:, None] * p / total
    rate = 1 / np.linalg.norm(a.T @ (p), 2)
    for _ in range(steps):
        r = a.T @ x - target / total
        if np.abs(r).max() < 1e-9:
            break
        x = np.maximum(0, x - rate * (p @ r))
    return a.T @ x * total


@pytest.mark.parametrize(("targets", "reachable"), [({"clean": 0.96, "low": 0.02, "toxic": 0.02}, True), ({"clean": 0.2, "low": 0.3, "toxic": 0.5}, True), ({"clean": 0.0, "low": 0.0, "toxic": 1.0}, False)])
def test_mixing_optimum(spark, targets, reachable):
    r = np.random.default_rng(5)
    t, p = r.integers(1, 900, 400), r.dirichlet([0.6, 0.3, 0.2], 400) * 0.97 + 0.01
    scored = spark.createDataFrame([(int(n), *map(float, q)) for n, q in zip(t, p, strict=True)], "n_tokens long, " + ", ".join(f"{c} double" for c in mixing.P))
    rates = mixing.fit_rates(scored, targets, total_tokens=float(t.sum()))
    x = scored.select(rates.column().alias("x")).toPandas()["x"].to_numpy()
    got, want = (t[:, None] * p * x[:, None]).sum(0), t.sum() * np.array(list(targets.values()))
    assert (x >= 0).all() and np.allclose(got, [g for _, _, g in rates.totals])
    brute = least_squares(t, p, want)
    assert np.linalg.norm(got - want) <= np.linalg.norm(brute - want) + 2e-4 * t.sum()
    assert (np.abs(got - want).max() <= 1e-4 * t.sum()) == reachable == (rates.unmet <= 1e-4)


def test_mixing_without_convergence(spark):
    scored = spark.createDataFrame([(100, 0.9, 0.05, 0.05), (100, 0.1, 0.8, 0.1), (100, 0.1, 0.1, 0.8)], "n_tokens long, " + ", ".join(f"{c} double" for c in mixing.P))
    with pytest.raises(mixing.NotConverged):
        mixing.fit_rates(scored, {"clean": 0.05, "low": 0.15, "toxic": 0.8}, most_steps=1)


def test_mixing_with_a_domain_out_of_reach(spark):
    """No document is low, as after quality rules: the others are mixed, nothing is dropped or repeated for it, and the gap is told."""
    rows = [(100, 0.98, 0.0005, 0.0195)] * 90 + [(100, 0.2, 0.0005, 0.7995)] * 10
    scored = spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"{c} double" for c in mixing.P))
    rates = mixing.fit_rates(scored, mixing.TARGETS)
    x = [r.x for r in scored.select(rates.column().alias("x")).collect()]
    assert max(x) < 1.2 and min(x[:90]) > 0.8 and 0.015 < rates.unmet < 0.025


def test_mixing_raises_a_scarce_domain(spark):
    r = random.Random(6)
    kinds = [0] * 900 + [1] * 95 + [2] * 5
    rows = []
    for k in kinds:
        a, b = r.uniform(0.0, 0.01), r.uniform(0.0, 0.002)
        p = [(1 - a - b, a, b), (a, 1 - a - b, b), (a, b, 1 - a - b)][k]
        rows.append((r.randrange(50, 150), *p))
    scored = spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"{c} double" for c in mixing.P))
    rates = mixing.fit_rates(scored, mixing.TARGETS)
    out = scored.withColumn("rate", rates.column()).toPandas()
    for c, (d, want, met) in zip(mixing.P, rates.totals, strict=True):
        got = (out["n_tokens"] * out["rate"] * out[c]).sum()
        assert abs(got - want) < 0.05 * want and abs(met - got) < 0.01 * want, d
    assert out["rate"].max() > 1


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (1, "http://a", "<p>x</p>"), (2, None, "y\r\n\r\nz"), (3, "http://c", None), (None, "http://d", ""), (4, "http://e", "w" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("f")).withColumn("digest", F.lit(1)).repartition(2)
    index = warc.build_index(spark, warc.write_archives(pages, str(tmp_path / "w")))
    assert sorted(map(str, [tuple(r)[:3] for r in warc.fetch(index).collect()])) == sorted(map(str, rows))
    assert [r.url for r in warc.fetch(index.where("url = 'http://e'")).collect()] == ["http://e"]
    assert warc.fetch(index.limit(0)).collect() == []
    assert warc.fetch(warc.build_index(spark, warc.write_archives(pages.limit(0), str(tmp_path / "v")))).collect() == []


def test_warc_damage():
    raw = warc.make_record(1, "u", "body")
    with pytest.raises(ValueError, match="truncated"):
        warc.parse(raw[:-20], "f at 0")
    with pytest.raises(ValueError, match="no WARC header"):
        warc.parse(b"nothing", "f at 0")


def test_companded_codecs():
    u, a = telephony.expansion("mulaw"), telephony.expansion("alaw")
    assert (u[0xFF], u[0x7F], u[0x00], u[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)


def adpcm_scalar(clip, block):
    out = []
    for at in range(0, len(clip), block):
        b = clip[at : at + block]
        if len(b) < 4:
            continue
        value, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(value)
        for n in (x for byte in b[4:] for x in (byte & 15, byte >> 4)):
            step = int(telephony._STEP[index])
            d = (step >> 3) + (step >> 2) * (n & 1) + (step >> 1) * (n >> 1 & 1) + step * (n >> 2 & 1)
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[n & 7]))
            out.append(value)
    return out


def test_adpcm_and_resampling():
    r = random.Random(8)
    clips = [r.randbytes(n) for n in (0, 3, 4, 5, 36, 37, 100, 259)]
    for clip, got in zip(clips, telephony.decode_adpcm(clips, 36), strict=True):
        assert got.tolist() == adpcm_scalar(clip, 36)
    t = np.arange(4000)
    y = telephony.resample(np.rint(9000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16), 8000, 16000)
    want = 9000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert len(y) == 8000 and np.abs(y[200:-200] - want[200:-200]).max() < 30


def test_telephony_errors():
    got = telephony.decode([None, {"codec": "x", "rate": 1, "block": 9, "data": b"a"}, {"codec": "alaw", "rate": 0, "block": 9, "data": b"a"}, {"codec": "ima_adpcm", "rate": 8000, "block": 4, "data": b"a"}, {"codec": "mulaw", "rate": 8000, "block": None, "data": b""}])
    assert [p for p, _, _ in got] == [None, None, None, None, b""] and [bool(e) for _, _, e in got] == [False, True, True, True, False]


SECRET = "aK9x2Lq8Zt5Rw1Vb"


@pytest.mark.parametrize("text", [f'password = "{SECRET}"', f"api_key: {SECRET}", f'{{"secret_token": "{SECRET}"}}', f'config["db_password"] = "{SECRET}"', f'a = "{SECRET[:8]}"\nb = "{SECRET[8:]}"\nauth_token = a + b', f'base = "{SECRET}"\nAPI_KEY="${{base}}"', f'x = "{SECRET}"\ntoken = f"{{x}}"', f"const clientSecret: string = '{SECRET}'"])
def test_secrets_found(text):
    assert [p.literal for p, _ in secret_scan.findings(text)] == [SECRET]


@pytest.mark.parametrize("text", ["password = os.environ['X']", 'token = "your_token_here"', "max_tokens: 4096", "The key: a word of prose.", f'title = "{SECRET}"', "", None])
def test_secrets_left_alone(text):
    assert secret_scan.findings(text) == []


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('password = "correcthorsebattery"', "correcthorsebattery"), ("DB_PASSWORD=correcthorsebattery\n", "correcthorsebattery"), ('passphrase = "correct horse battery staple"', "correct horse battery staple"),
        ("password = '$ecretP4ss!'", "$ecretP4ss!"), ("password_hash = '$2b$12$EixZaYVK1fsbw1ZfbX3OXe'", "$2b$12$EixZaYVK1fsbw1ZfbX3OXe"), ("password = '%9xQ!rT2w'", "%9xQ!rT2w"),
        (f'process.env.API_KEY = "{SECRET}"', SECRET), (f'config.url.password = "{SECRET}"', SECRET), (f'key = "{SECRET}"', SECRET), (f'salt = "{SECRET}"', SECRET), ('pin = "4821"', "4821"),
    ],
)
def test_secrets_of_each_class(text, literal):
    assert [p.literal for p, _ in secret_scan.findings(text)] == [literal]


@pytest.mark.parametrize("text", ['password = "${DB_PASSWORD}"', 'password = "$DB_PASSWORD"', 'password = "%(password)s"', 'secret = "${A}:${B}"', 'config.password_file = "correcthorsebattery"', "password = correcthorsebattery", 'token = "identifier"', "key: value of prose"])
def test_references_left_alone(text):
    assert secret_scan.findings(text) == []
