"""Quality classifier by attention-based multiple-instance learning (operator 1).

A document is a bag of passages of 64 words, all of them. Each passage is encoded (a learned tanh layer over the text
statistics and discriminating words of features.py); a gated attention, softmax(w . (tanh(V h) * sigmoid(U h))) over the
passages of a document, weighs the encodings, and a logistic unit scores their weighted sum. Only documents are labelled: the gradient
of the document loss teaches the attention which passages matter.

The model is fitted on the driver, on at most max_train labelled documents of each class, drawn by a hash of doc_id; what
is collected are their passage features (about 40 numbers for 64 words), not their texts. Scoring is one pass over all documents without a shuffle.

Defined results: a null or empty text is one empty passage; labels with a null doc_id or quality are ignored, of conflicting
ones the lower quality counts; repeated rows are scored alike and rows with a null doc_id are scored too; without labels of both
classes every score is 0.5; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import map_rows, materialize, require

PASSAGE_WORDS = 64
CLASSES = {"good": "quality > 0", "bad": "quality <= 0"}
THRESHOLD = 0.5


def passages(text: str | None, size: int = PASSAGE_WORDS) -> list[str]:
    """All words of text in passages of `size`; a rest shorter than a quarter of that belongs to the last."""
    words = (text or "").split()
    at = list(range(0, len(words), size)) or [0]
    if len(at) > 1 and len(words) - at[-1] < size // 4:
        at.pop()
    return [" ".join(words[a:b]) for a, b in zip(at, [*at[1:], len(words)], strict=True)]


def bags(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All passages, and where each document's begin."""
    split = [passages(t) for t in texts]
    return [p for s in split for p in s], np.cumsum([0, *map(len, split)])[:-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Attention:
    """The network; every array in `p` is a parameter."""

    chosen: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, width: int, code: int = 24, gate: int = 16, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        draw = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"E": draw(width, code), "e": np.zeros(code), "V": draw(code, gate), "U": draw(code, gate), "w": draw(gate, 1), "c": draw(code, 1), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = ((t * g) @ p["w"])[:, 0]
        a = np.exp(s - np.maximum.reduceat(s, first)[seg])
        a /= np.add.reduceat(a, first)[seg]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"seg": seg, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])[:, 0]}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        do = ((f["y"] - y) * weight)[:, None]
        dz = (do @ p["c"].T)[f["seg"]]
        da = (f["h"] * dz).sum(1)
        ds = (f["a"] * (da - np.add.reduceat(f["a"] * da, first)[f["seg"]]))[:, None]
        dt, dg = ds @ p["w"].T * f["g"] * (1 - f["t"] ** 2), ds @ p["w"].T * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ do, "b": do.sum(0)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> None:
        share = np.bincount(y, minlength=2)
        weight = 1 / (2.0 * share[y])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            for k, g in self.gradients(x, first, y, weight).items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: score, passages, the passage with most attention and its weight."""
        parts, first = bags(texts)
        count = np.diff(np.append(first, len(parts)))
        if not self.p:
            return np.full(len(texts), 0.5), count, np.zeros(len(texts), int), 1 / np.maximum(count, 1)
        f = self.forward((features.encode(parts, self.chosen) - self.mean) / self.scale, first)
        top = np.maximum.reduceat(f["a"], first)
        at = np.flatnonzero(f["a"] == top[f["seg"]])
        _, one = np.unique(f["seg"][at], return_index=True)
        return f["y"], count, at[one] - first, top


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 1500, n_words: int = 32) -> Attention:
    sample, _ = features.labelled_sample(docs, labels.where("quality is not null"), CLASSES, max_train)
    sample = materialize(sample, "sample")
    chosen = features.choose_buckets(sample, list(CLASSES), n_words)

    def fn(cols: list[list]) -> dict:
        parts, first = bags(cols[2])
        return {"doc_id": cols[0], "class": cols[1], "x": [m.ravel().tolist() for m in np.split(features.encode(parts, chosen), first[1:])]}

    rows = map_rows(sample, ["doc_id", "class", "text"], fn, "doc_id long, class string, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    width = len(chosen) + len(features.RULES)
    if rows["class"].nunique() < 2:
        return Attention(chosen, np.zeros(width), np.ones(width))
    each = [np.asarray(v, np.float64).reshape(-1, width) for v in rows["x"]]
    x, first = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
    model = Attention(chosen, x.mean(0), np.maximum(x.std(0), 0.02))
    model.start(width)
    model.fit((x - model.mean) / model.scale, first, (rows["class"] == "good").to_numpy().astype(int))
    return model


def scored(docs: DataFrame, model: Attention, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, passages, score, the most attended passage, its weight, and whether to keep the document."""
    require(docs, "doc_id", "text")

    def fn(cols: list[list]) -> dict:
        score, count, top, weight = model.score(cols[1])
        return {"doc_id": cols[0], "passages": count, "score": score, "top_passage": top, "top_weight": weight, "keep": score >= threshold}

    schema = "doc_id long, passages int, score double, top_passage int, top_weight double, keep boolean"
    return map_rows(docs, [F.col("doc_id").cast("long"), "text"], fn, schema)


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
