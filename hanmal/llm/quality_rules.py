"""Risk-controlled quality rules (operator 8).

Every rule is a statistic of the whole text, larger for worse texts, and rejects a document whose value exceeds the
cutoff of the document's stratum (its language). Cutoffs come from labelled holdouts. For each rule and stratum the
cutoffs of a fixed grid are tested from the most lenient one on: the exact binomial test asks whether the share of
good documents that the cutoff rejects is below the rule's share of the allowed risk. Testing stops at the first failure
(a fixed sequence needs no further correction), and Bonferroni's correction covers all rules and strata. So with
probability 1 - delta, no stratum loses more than the share alpha of its good documents to all its rules together.
Among the certified cutoffs the one with the best balance of rejected bad and good documents is used, the most lenient
of equals; where nothing can be certified, the rule rejects nothing in that stratum.

Labels and counts cover all labelled documents: what reaches the driver is a histogram of strata x rules x cutoffs.

Defined results: a null or empty text counts as the empty text (shortness 2, all else 0); a null language is a stratum of
its own; labels whose quality or doc_id is null are ignored, of conflicting or repeated labels the lowest quality counts
once; of rows that share a doc_id the one with the smallest hash of its text stands for the labelled document; repeated rows are judged alike; without documents or labels nothing is rejected; other columns are passed through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import chunks, fingerprint, map_rows, materialize, maybe_among, one_label, require

RULES = ("symbol_share", "upper_share", "repeat_share", "bare_share", "top_share", "exclaim_share", "shortness", "word_length", "digit_share")
#: A value is rejected when it exceeds the cutoff; the first rejects no share of 1 at all.
GRID = 2.0 ** (-np.arange(57) / 8)


def rule_values(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The statistic of each rule for each text."""
    t = tv.Texts(texts)
    letter = (t.kind == tv.LOWER) | (t.kind == tv.UPPER) | (t.kind == tv.LETTER)
    alnum = letter | (t.kind == tv.DIGIT)
    n_visible, n_alnum = t.per_text(t.kind != tv.SPACE), t.per_text(alnum)
    wb, we = t.words()
    owner = t.text_of(wb)
    n_words = np.bincount(owner, minlength=t.n)
    h = t.hashes(wb, we)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    g, _, c = tv.group_counts(owner, h)
    top = np.zeros(t.n, np.int64)
    np.maximum.at(top, g, c)
    tb, te = t.tokens()
    n_tokens = np.bincount(t.text_of(tb), minlength=t.n)
    seen = np.concatenate(([0], np.cumsum(alnum)))
    bare = np.bincount(t.text_of(tb[seen[te] == seen[tb]]), minlength=t.n)
    share = lambda a, b: a / np.maximum(b, 1)
    return {
        "symbol_share": share(t.per_text(t.kind == tv.OTHER), n_visible),
        "upper_share": share(t.per_text(t.kind == tv.UPPER), t.per_text(letter)),
        "repeat_share": share(np.bincount(owner[same], minlength=t.n), n_words),
        "bare_share": share(bare, n_tokens),
        "top_share": share(top, n_words),
        "exclaim_share": share(t.per_text(t.cp == ord("!")), n_tokens),
        "shortness": np.where(n_words > 0, 1 / np.maximum(n_words, 1), 2.0),
        "word_length": share(np.bincount(owner, we - wb, minlength=t.n), n_words) / 64,
        "digit_share": share(t.per_text(t.kind == tv.DIGIT), n_alnum),
    }


def with_values(docs: DataFrame, *columns: str) -> DataFrame:
    """columns of docs, and each rule's value."""
    require(docs, "text", *columns)
    kinds = dict(docs.select(*columns).dtypes)

    def fn(cols: list[list]) -> dict:
        return dict(zip(columns, cols, strict=False)) | rule_values(cols[-1])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"{r} double" for r in RULES])
    return map_rows(docs, [*columns, "text"], fn, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly but for terms below 1e-18 of the sum; 1 where k > n p."""
    if n <= 0 or k >= n or k > n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = term
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < total * 1e-18:
            break
    return total


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float, weight: float) -> int | None:
    """good, bad: documents first rejected at each place of GRID (last: never). The place of the cutoff to use."""
    n, best, at = int(good.sum()), 0.0, None
    lost, won = np.cumsum(good), np.cumsum(bad)
    for i in range(len(GRID)):
        if binomial_tail(int(lost[i]), n, risk) > level:
            break
        gain = won[i] - weight * lost[i]
        if gain > best:
            best, at = gain, i
    return at


def fit(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, weight: float = 5.0) -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum and rule. weight: bad documents that one good one is worth in the choice of a cutoff."""
    labelled = materialize(one_label(labels).select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), "labelled")
    place = F.array(*[F.expr(f"size(filter(grid, c -> c >= {r}))") for r in RULES])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", fingerprint().alias("fp"), "text").where("doc_id is not null")
    own = maybe_among(own, F.col("doc_id"), labelled.select(F.col("doc_id").alias("k")))  # rules are computed for labelled documents only
    one = with_values(own, "doc_id", "lang", "fp").groupBy("doc_id").agg(F.min_by(F.struct("lang", *RULES), F.coalesce("fp", F.lit(0))).alias("x")).select("doc_id", "x.*")
    counts = (
        one.join(labelled, "doc_id").withColumn("grid", F.lit(GRID.tolist()))
        .select("lang", (F.col("quality") > 0).alias("good"), F.posexplode(place).alias("rule", "place"))
        .groupBy("lang", "rule", "place", "good").count().collect()
    )
    hist: dict = {}
    for r in counts:
        hist.setdefault(r["lang"], np.zeros((len(RULES), 2, len(GRID) + 1), np.int64))[r["rule"], int(r["good"]), r["place"]] += r["count"]
    level = delta / (len(RULES) * max(1, len(hist)))
    out: dict = {}
    for lang, h in hist.items():
        picked = {r: choose_cutoff(h[i, 1], h[i, 0], alpha / len(RULES), level, weight) for i, r in enumerate(RULES)}
        out[lang] = {r: float(GRID[i]) for r, i in picked.items() if i is not None}
    return out


def rejected(values: dict[str, np.ndarray], langs: list, cutoffs: dict) -> np.ndarray:
    """Which texts some rule of their stratum rejects."""
    out = np.zeros(len(langs), bool)
    for r in RULES:
        most = np.array([cutoffs.get(x, {}).get(r, np.inf) for x in langs])
        out |= values[r] > most
    return out


def keep(docs: DataFrame, cutoffs: dict) -> DataFrame:
    """The rows of docs that no rule rejects, in one pass without a shuffle."""
    require(docs, "text", "lang")
    names = [f.name for f in docs.schema]

    def run(batches):
        for batch in batches:
            own = batch.select([*range(len(names))])
            for part in chunks(own.append_column("__text", own.column(names.index("text")))):
                langs = part.column(names.index("lang")).to_pylist()
                bad = rejected(rule_values(part.column(len(names)).to_pylist()), langs, cutoffs)
                yield part.select([*range(len(names))]).filter(pa.array(~bad))

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots or backticks can't pass through Python
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def apply(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Documents that pass the rules fitted on all labels."""
    return keep(docs, fit(docs, labels, alpha, delta))
