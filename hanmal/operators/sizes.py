"""Broadcasting behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes, as the plan knows them before it runs, up to which a dictionary is broadcast.
MOST_BYTES = 64 << 20
#: Bytes of a part of a spread table.
PART = 1 << 20


def small(dic: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """dic with a broadcast hint if its source is at most `most` bytes; else adaptive execution decides by the size it turns out to have. Runs no job."""
    return F.broadcast(dic) if planned_bytes(dic) <= most else dic


def planned_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """df in parts of about PART bytes, three for each core at least; for small tables that one task would read and much is made of. Those beyond `most` bytes stay as they are. Runs no job."""
    size = planned_bytes(df)
    if most is not None and size > most:
        return df
    return df.repartition(max(3 * df.sparkSession.sparkContext.defaultParallelism, size // PART))
