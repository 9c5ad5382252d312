"""Mixing sources to target weights by soft membership (operator 2).

1. A softmax classifier, fitted on a bounded sample of the labels table (at most max_train documents of each class),
   predicts for every document its posteriors over the domains: low quality, toxic, clean. The classes are sampled alike
   and the intercepts corrected to their shares among all labels.
2. Document rates x >= 0 are fitted so that the expected domain token totals sum(x * tokens * posterior) match the targets: least squares by
   projected gradient steps from x = 1, with no upper bound unless max_rate sets one. The gradient of a document's rate is its
   posteriors times the residuals, so after any steps x is the projection of 1 - posteriors * mu onto the bounds, mu being the steps so
   far, three numbers. An iteration is one aggregation over all documents that computes their rates anew; nothing per document is held. Steps are taken in
   the metric of the Gram matrix of the documents between their bounds, and halved while they do not help. A small ridge towards 1 (RIDGE) makes the optimum unique.
3. A document is drawn floor(x) times, and once more if a hash of its doc_id says so.

Unless total_tokens is given, the total is the one at which the domain with the largest target keeps its tokens. A domain that holds
less than its target is repeated. Another domain that
the posteriors hardly tell from the rest (its tokens' mean posterior is above its share by less than MIN_SEPARATION of what a perfect classifier's would be, as when an
earlier stage took all its documents or what gave them away) is out of reach, and left out of the fit, which else would repeat a few odd documents thousands
of times and drop all others. `unmet`, the largest
difference from a target as a share of the total, is a column of every row, and is logged. A descent that has not settled after most_steps raises NotConverged.
Tokens are those of operator 5.

Defined results: null and empty texts have no tokens and the posteriors of the empty text; labels with a null doc_id or quality
are ignored and a null toxic counts as 0; of several labels of one document the lowest quality and the highest toxic count; a null
doc_id is drawn by a hash of its text; repeated rows are drawn alike; an empty table gives an empty table; without labels all
posteriors are equal, so that no rates can meet unequal targets; other columns are passed on by apply(), whatever their names.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features
from .common import fingerprint, map_rows, materialize, own_columns, require, unused
from .tokens import VOCABULARY, count_tokens

#: Conditions on labels, which exclude each other.
DOMAINS = {"clean": "quality > 0 and coalesce(toxic, 0) <= 0", "low": "quality <= 0", "toxic": "quality > 0 and toxic > 0"}
TARGETS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}
RIDGE = 1e-7
MIN_SEPARATION = 0.02
#: Gradients below this share of the total count as nought.
GRADIENT = 1e-6
log = logging.getLogger(__name__)
P = [f"p_{d}" for d in DOMAINS]


@dataclass(frozen=True)
class Softmax:
    chosen: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        z = ((features.encode(texts, self.chosen) - self.mean) / self.scale) @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, n_classes: int, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by full-batch Adam, with each class weighted alike."""
    w, b = np.zeros((x.shape[1], n_classes)), np.zeros(n_classes)
    share = np.bincount(y, minlength=n_classes)
    each = (1 / np.maximum(share, 1) / max(1, (share > 0).sum()))[y][:, None]
    hot = np.eye(n_classes)[y]
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = x @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        err = (z / z.sum(1, keepdims=True) - hot) * each
        for k, (p, g) in enumerate(((w, x.T @ err + decay * w), (b, err.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    return w, b


def fit_classifier(docs: DataFrame, labels: DataFrame, max_train: int = 3000, n_words: int = 96) -> Softmax:
    names = list(DOMAINS)
    sample, sizes = features.labelled_sample(docs, labels, DOMAINS, max_train)
    sample = materialize(sample, "sample")
    chosen = features.choose_buckets(sample, names, n_words)
    width = len(chosen) + len(features.RULES)

    def fn(cols: list[list]) -> dict:
        return {"class": cols[1], "doc_id": cols[0], "x": list(features.encode(cols[2], chosen))}

    rows = map_rows(sample, ["doc_id", "class", "text"], fn, "class string, doc_id long, x array<float>").toPandas()
    rows = rows.sort_values(["class", "doc_id"], kind="stable")
    if rows.empty:
        return Softmax(chosen, np.zeros(width), np.ones(width), np.zeros((width, len(names))), np.zeros(len(names)))
    x = np.stack(rows["x"].to_list()).astype(np.float64)
    y = rows["class"].map({n: i for i, n in enumerate(names)}).to_numpy()
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    w, b = fit_softmax((x - mean) / scale, y, len(names))
    prior = np.array([sizes.get(n, 0) for n in names], float)
    return Softmax(chosen, mean, scale, w, b + np.log(np.maximum(prior / prior.sum(), 1e-6)))


def with_posteriors(docs: DataFrame, model: Softmax, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, fp, n_tokens and the posteriors of each row."""
    require(docs, "doc_id", "text")

    def fn(cols: list[list]) -> dict:
        p = model.posteriors(cols[2])
        return {"doc_id": cols[0], "fp": cols[1], "n_tokens": [count_tokens(x, vocabulary) for x in cols[2]]} | {c: p[:, i] for i, c in enumerate(P)}

    schema = "doc_id long, fp long, n_tokens long, " + ", ".join(f"{c} double" for c in P)
    return map_rows(docs, [F.col("doc_id").cast("long"), fingerprint(), "text"], fn, schema)


class NotConverged(RuntimeError):
    """The descent met neither its targets nor a stationary point."""


@dataclass(frozen=True)
class Rates:
    """Rates as a function of posteriors: 1 - posteriors * mu, projected to [0, max_rate]."""

    mu: tuple[float, ...] = ()
    max_rate: float | None = None
    #: By domain: wanted and achieved expected tokens.
    totals: tuple[tuple[str, float, float], ...] = ()
    #: The largest difference between these, as a share of all wanted tokens.
    unmet: float = 0.0

    def column(self) -> Column:
        if not self.mu:
            return F.lit(1.0)
        x = F.greatest(F.lit(0.0), 1 - sum((F.col(c) * v for c, v in zip(P[1:], self.mu[1:], strict=True)), F.col(P[0]) * self.mu[0]))
        return x if self.max_rate is None else F.least(F.lit(float(self.max_rate)), x)


def _state(scored: DataFrame, rates: Rates, total: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Of all documents at some rates, as shares of the total: domain totals, the Gram matrix of the documents between their bounds, and half the squares of the
    rates (the dual of the least squares, whose gradient the totals are)."""
    t, x = F.col("n_tokens").cast("double"), F.col("x")
    free_rate = 1 - sum((F.col(c) * v for c, v in zip(P[1:], rates.mu[1:], strict=True)), F.col(P[0]) * rates.mu[0])
    free = (x > 0) & (F.lit(True) if rates.max_rate is None else x < rates.max_rate)
    pairs = [(i, j) for i in range(len(P)) for j in range(i, len(P))]
    sums = [F.sum(t * x * F.col(c)).alias(c) for c in P] + [F.sum(F.when(free, t * F.col(P[i]) * F.col(P[j]))).alias(f"g{i}{j}") for i, j in pairs]
    row = scored.select("n_tokens", *P, rates.column().alias("x")).agg(*sums, F.sum(t * (x * free_rate - x * x / 2)).alias("value")).first()
    gram = np.zeros((len(P), len(P)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = (row[f"g{i}{j}"] or 0.0) / total
    return np.array([row[c] or 0.0 for c in P]) / total, gram, (row["value"] or 0.0) / total


def fit_rates(scored: DataFrame, targets: dict[str, float], total_tokens: float | None = None, max_rate: float | None = None, tolerance: float = 1e-4, most_steps: int = 200) -> Rates:
    """scored: n_tokens and posteriors, cheap to read more than once."""
    w = np.array([targets[d] for d in DOMAINS], float)
    w = w / w.sum()
    t = F.col("n_tokens").cast("double")
    first = scored.agg(*[F.sum(t * F.col(c)).alias(c) for c in P], *[F.sum(t * F.col(c) * F.col(c)).alias(f"square_{c}") for c in P]).first()
    have, square = (np.array([first[f"{x}{c}"] or 0.0 for c in P]) for x in ("", "square_"))
    if not have.sum():
        return Rates((), max_rate)
    lead = int(np.argmax(w))
    total = total_tokens or float(have[lead] / w[lead] if have[lead] else have.sum())
    share = have / have.sum()
    told = (square / np.maximum(have, 1e-300) - share) / np.maximum(1 - share, 1e-300)
    fitted = (told >= MIN_SEPARATION) | (np.arange(len(P)) == lead)  # the others are out of reach
    gradient = lambda mu, got: np.where(fitted, got - w - RIDGE * mu, 0.0)
    mu = np.zeros(len(P))
    got, gram, value = _state(scored, Rates(tuple(mu), max_rate), total)
    g, steps = gradient(mu, got), 0
    dual = lambda mu, value: value + float(w @ np.where(fitted, mu, 0.0)) + RIDGE / 2 * float(mu @ mu)
    while np.abs(g).max() > GRADIENT:
        way = np.zeros(len(P))
        way[fitted] = np.linalg.solve(gram[np.ix_(fitted, fitted)] + RIDGE * np.eye(fitted.sum()), g[fitted])
        size = 1.0
        while True:
            steps += 1
            if steps > most_steps:
                raise NotConverged(f"after {most_steps} steps the domain totals are {got.round(5).tolist()} of {w.round(5).tolist()}")
            tried = mu + size * way
            new, curve, height = _state(scored, Rates(tuple(tried), max_rate), total)
            if dual(tried, height) <= dual(mu, value) - 1e-4 * size * float(g @ way) or size < 1e-6:
                break
            size /= 2
        if size < 1e-6:  # rounding is all that is left
            break
        mu, got, gram, value = tried, new, curve, height
        g = gradient(mu, got)
    totals = tuple((d, float(a * total), float(x * total)) for d, a, x in zip(DOMAINS, w, got, strict=True))
    for d, want, met in totals:
        log.log(logging.WARNING if abs(met - want) > tolerance * total else logging.INFO, "domain %s: target %.0f tokens, achieved %.0f", d, want, met)
    return Rates(tuple(map(float, mu)), max_rate, totals, float(np.abs(got - w).max()))


def copies(rate: Column, seed: int = 11) -> Column:
    """How often a document is drawn."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.col("fp")), F.lit(seed))
    u = F.pmod(key, F.lit(1 << 53)) / float(1 << 53)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, fp, n_tokens, posteriors, rate, copies and unmet of each row."""
    scored = materialize(with_posteriors(docs, fit_classifier(docs, labels), vocabulary), "posteriors")
    rates = fit_rates(scored, targets, max_rate=max_rate)
    return scored.withColumn("rate", rates.column()).withColumn("copies", copies(F.col("rate"))).withColumn("unmet", F.lit(rates.unmet))


def realised(rated_docs: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """domain, target, and the shares of tokens that it has among all documents, in expectation at the rates, and among the copies drawn."""
    t = F.col("n_tokens").cast("double")
    sums = {"had": t, "expected": t * F.col("rate"), "drawn": t * F.col("copies")}
    one = rated_docs.agg(*[F.sum(w * F.col(c)).alias(f"{k}_{c}") for k, w in sums.items() for c in P], *[F.sum(w).alias(k) for k, w in sums.items()])
    rows = [F.struct(F.lit(d).alias("domain"), F.lit(targets[d] / sum(targets.values())).alias("target"), *[(F.col(f"{k}_{c}") / F.col(k)).alias(k) for k in sums]) for d, c in zip(DOMAINS, P, strict=True)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def apply(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs, each row as often as it is drawn."""
    key, print_, n = unused(docs, "id", "fp", "n")
    drawn = rated(docs, labels, targets, max_rate, vocabulary).where("copies > 0")
    drawn = drawn.select(F.col("doc_id").alias(key), F.col("fp").alias(print_), F.col("copies").alias(n)).distinct()
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & fingerprint().eqNullSafe(F.col(print_))
    out = docs.join(drawn.hint("shuffle_hash"), on)
    return out.select(*own_columns(docs), F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).drop(n)
