"""Text features shared by the trained operators: the quality statistics and the words that tell labels apart.

Words fall into 2**18 hash buckets. A bucket becomes a feature when it is among those whose presence differs most between
the label classes of a bounded sample (chi-squared). So a text, or a passage of one, is a short dense vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import map_rows, one_label
from .quality_rules import RULES, rule_values

BUCKETS = 1 << 18
#: Documents of a class that must hold a bucket before chi-squared means anything: with fewer, every word of a class of two documents would be its sign.
MIN_SEEN = 3


def word_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of each word."""
    t = tv.Texts([x.lower() if x else x for x in texts])
    begin, end = t.words()
    return t.text_of(begin), (t.hashes(begin, end) >> np.uint64(46)).astype(np.int64)


def encode(texts: list[str | None], chosen: np.ndarray) -> np.ndarray:
    """One row for each text: log counts of the chosen buckets per hundred words' square root, then the statistics."""
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    owner, bucket = word_buckets(texts)
    n = len(texts)
    words = np.bincount(owner, minlength=n)
    at = place[bucket]
    counts = np.bincount(owner[at >= 0] * len(chosen) + at[at >= 0], minlength=n * len(chosen)).reshape(n, len(chosen))
    lexical = np.log1p(counts) / np.sqrt(np.maximum(words, 25) / 100)[:, None]
    values = rule_values(texts)
    return np.column_stack([lexical, *[np.sqrt(values[r]) for r in RULES]]).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, classes: dict[str, str], most: int, seed: int = 7) -> tuple[DataFrame, dict[str, int]]:
    """Up to `most` labelled documents of each class, those with the smallest hashes of doc_id, and the class sizes.

    classes: SQL conditions on labels by name, which exclude each other. Returns doc_id, class, text; all labels are
    counted. The sampled ids are at most `most` for each class, so they are broadcast.
    """
    own = one_label(labels).withColumn("class", F.coalesce(*[F.when(F.expr(c), F.lit(k)) for k, c in classes.items()])).where("class is not null")
    sizes = {r["class"]: r["count"] for r in own.groupBy("class").count().collect()}
    picked = None
    for k in classes:
        part = own.where(F.col("class") == k).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    picked = picked.select(F.col("doc_id").cast("long").alias("__id"), "class")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    return found.select("doc_id", "class", "text"), sizes


def choose_buckets(sample: DataFrame, names: list[str], n_chosen: int) -> np.ndarray:
    """The buckets whose presence in texts depends most on the class."""

    def fn(cols: list[list]) -> dict:
        owner, bucket = word_buckets(cols[1])
        pair = np.unique(owner * BUCKETS + bucket)
        edges = np.searchsorted(pair, np.arange(1, len(cols[1])) * BUCKETS)
        return {"class": cols[0], "buckets": [(x % BUCKETS).tolist() for x in np.split(pair, edges)]}

    rows = map_rows(sample, ["class", "text"], fn, "class string, buckets array<int>").select("class", F.explode("buckets").alias("b")).groupBy("class", "b").count()
    total = {r["class"]: r["count"] for r in sample.groupBy("class").count().collect()}
    seen = np.zeros((len(names), BUCKETS))
    counts = rows.where(F.col("count") >= MIN_SEEN).toPandas()
    for k, name in enumerate(names):
        own = counts[counts["class"] == name]
        seen[k, own["b"].to_numpy(np.int64)] = own["count"].to_numpy()
    n = np.array([total.get(x, 0) for x in names], float)
    p = seen.sum(0) / max(1.0, n.sum())
    expected = n[:, None] * p
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num(((seen - expected) ** 2 / expected / np.maximum(1 - p, 1e-9)).sum(0))
    order = np.lexsort((np.arange(BUCKETS), -chi))[:n_chosen]
    return np.sort(order[chi[order] > 0])
