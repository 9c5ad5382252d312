"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for the ends of edges (a, b), the component being its smallest id.

    Alternates the large-star and small-star contractions; each round is two aggregations and joins over the edges left,
    written to the shared folder. Self loops and repeated edges do no harm.
    """
    tally = lambda df: df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    was = tally(now)
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        new = materialize(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct(), "edges")
        discard(now)
        now, before, was = new, was, tally(new)
        if was == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
