"""Optimal length buckets and token-budget batches (operator 5).

The histogram of token counts over all documents is taken by one aggregation. Dynamic programming over it finds the at
most `buckets` boundaries that minimise the padding, the tokens added when each document is padded to the boundary of
its bucket. Within a bucket, documents in order of doc_id fill batches: a batch holds as many rows of the padded length as the token
budget allows, and at least one, so a document longer than the budget is a batch of its own. Nothing is cut.

Positions within a bucket are exact global ranks without a global sort in one task: documents are range-partitioned by
(bucket, doc_id), the counts per partition and bucket are summed up, and local ranks are shifted by them.

The driver holds the exact histogram: a row for each distinct token count, so its size grows with the longest text, never with the
number of documents. The programme is exact, in integers, and linear in the histogram for each bucket.

Defined results: null, empty texts have 0 tokens and go into the first bucket; a null doc_id ranks before all others;
repeated rows are packed as often as they occur; ties of doc_id are ordered by a hash of the text; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .tokens import VOCABULARY, with_counts

TOKEN_BUDGET = 65536
BUCKETS = 16


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper boundaries, among the ascending lengths, of the at most `buckets` ranges with the least padding.

    Lengths i .. j-1 in one bucket cost x[j-1] * (N[j] - N[i]) - (M[j] - M[i]) tokens of padding, N and M being the running counts and
    tokens. For fixed j this is the least of the lines best[i] + M[i] - N[i] * x at x = x[j-1]; their slopes fall with i and
    the places rise with j, so one pass over their lower envelope finds all of a bucket's cuts.
    """
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    number = [0, *accumulate(counts)]
    mass = [0, *accumulate(a * b for a, b in zip(lengths, counts, strict=True))]
    best: list[int | None] = [0] + [lengths[j - 1] * number[j] - mass[j] for j in range(1, n + 1)]
    cuts = []
    for _ in range(buckets - 1):
        new, cut, lines, front = list(best), [-1] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1  # the line that may now be used
            slope, base = -number[i], best[i] + mass[i]
            while len(lines) - front >= 2:
                (s1, b1, _), (s2, b2, _) = lines[-2], lines[-1]
                if (base - b1) * (s1 - s2) > (b2 - b1) * (s1 - slope):
                    break
                lines.pop()  # the last line is nowhere below both of its neighbours
            lines.append((slope, base, i))
            x = lengths[j - 1]
            while len(lines) - front >= 2 and lines[front + 1][0] * x + lines[front + 1][1] <= lines[front][0] * x + lines[front][1]:
                front += 1
            least = lines[front][0] * x + lines[front][1] + x * number[j] - mass[j]
            if least < best[j]:
                new[j], cut[j] = least, lines[front][2]
        cuts.append(cut)
        best = new
    out, j = [], n
    for cut in reversed(cuts):
        if cut[j] >= 0:
            out.append(lengths[j - 1])
            j = cut[j]
            if j == 0:
                return sorted(out)
    out.append(lengths[j - 1])
    return sorted(set(out))


def boundaries(counted: DataFrame, buckets: int) -> list[int]:
    """Bucket boundaries for a table with n_tokens, from the histogram of all of it."""
    rows = counted.groupBy(F.col("n_tokens").alias("length")).count().collect()
    hist = sorted((r["length"], r["count"]) for r in rows)
    return optimal_boundaries([a for a, _ in hist], [b for _, b in hist], buckets)


def pack(counted: DataFrame, token_budget: int = TOKEN_BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """counted: doc_id, fp, n_tokens, cheap to read more than once."""
    bounds = boundaries(counted, buckets)
    if not bounds:
        bounds = [0]
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0)).cast("int")
    placed = counted.withColumn("bucket", bucket).withColumn("bucket_len", F.lit(bounds)[F.col("bucket")].cast("long"))
    ranged = placed.repartitionByRange("bucket", F.col("doc_id").asc_nulls_first(), "fp").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("bucket", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(F.col("doc_id").asc_nulls_first(), "fp"))
    rows = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return (
        ranged.withColumn("local", local).join(sizes, ["bucket", "part"])
        .withColumn("at", F.col("before") + F.col("local") - 1)
        .select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("at") / rows).cast("long").alias("batch"), (F.col("at") % rows).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
    )


def apply(docs: DataFrame, token_budget: int = TOKEN_BUDGET, buckets: int = BUCKETS, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each document its tokens, bucket, batch within the bucket, slot within the batch, and padding."""
    return pack(materialize(with_counts(docs, vocabulary), "counted"), token_budget, buckets)
