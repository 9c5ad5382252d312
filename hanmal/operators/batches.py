"""Arrow passes: columns added or rows made a batch at a time, without a shuffle, so that streams can use them too."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of input that are held as Python objects at once, and rows that are made before they are sent; a row that is larger goes alone.
PIECE, MOST_ROWS = 256 << 10, 65536


def pieces(batch: pa.RecordBatch, inputs: list[int], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """batch in parts whose input columns have at most `most` bytes, or a single row."""
    if not batch.num_rows:
        return
    if batch.num_rows == 1 or sum(batch.column(i).nbytes for i in inputs) <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), inputs, most)
    yield from pieces(batch.slice(half), inputs, most)


def with_columns(df: DataFrame, inputs: list[str], fn: Callable[[list[list]], list[list | pa.Array]], added: str) -> DataFrame:
    """df and the columns of `added` (DDL), which fn computes from the lists of the input columns; of equal names the new one stays."""
    new = StructType.fromDDL(added)
    kept = [f for f in df.schema if f.name not in new.names]
    at = [df.columns.index(c) for c in inputs]
    # plain names on the way through Python, which can't take every name
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    own = [df.columns.index(f.name) for f in kept]
    out = StructType([StructField(f"o{i}", f.dataType) for i, f in enumerate([*kept, *new])])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, at)):
            got = fn([batch.column(i).to_pylist() for i in at])
            made = [x.cast(arrow.field(len(own) + k).type) if isinstance(x, pa.Array) else pa.array(x, arrow.field(len(own) + k).type) for k, x in enumerate(got)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).cast(arrow.field(k).type) for k, i in enumerate(own)], *made], schema=arrow)

    return plain.mapInArrow(run, out).toDF(*[f.name for f in kept], *new.names)


def rows_of(df: DataFrame, keep: list[str], text: str, fn: Callable[[list[str]], tuple | Iterable[tuple]], made: str) -> DataFrame:
    """Rows made of a text column. fn gets the texts (null as '') and returns the number of the text of each row, and the columns of `made` (DDL); or several of these, for rows that are many."""
    new = StructType.fromDDL(made)
    kinds = {f.name: f.dataType for f in df.schema}
    src = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].alias("text"))
    out = StructType([*[StructField(f"k{i}", kinds[c]) for i, c in enumerate(keep)], *new])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, [len(keep)])):
            got = fn([x or "" for x in batch.column(len(keep)).to_pylist()])
            for owner, columns in [got] if isinstance(got, tuple) else got:
                take = pa.array(owner)
                own = [batch.column(i).take(take).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *columns], schema=arrow)

    return src.mapInArrow(run, out).toDF(*keep, *new.names)


def rows_from(df: DataFrame, keep: list[str], inputs: list[str], fn: Callable[..., Iterable[tuple]], made: str) -> DataFrame:
    """The columns `keep` of each row of df beside each of the tuples that fn makes of its inputs, columns `made` (DDL)."""
    new = StructType.fromDDL(made)
    kinds = {f.name: f.dataType for f in df.schema}
    src = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], *[df[c].alias(f"i{i}") for i, c in enumerate(inputs)])
    out = StructType([*[StructField(f"k{i}", kinds[c]) for i, c in enumerate(keep)], *[StructField(f"o{i}", f.dataType) for i, f in enumerate(new)]])
    arrow, n = to_arrow_schema(out), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, list(range(n, n + len(inputs))))):
            owners: list[tuple[int, int]] = []
            rows: list[tuple] = []

            def sent() -> pa.RecordBatch:
                take = pa.array(np.repeat(*np.array(owners, np.int32).T))
                own = [batch.column(i).take(take).cast(arrow.field(i).type) for i in range(n)]
                return pa.RecordBatch.from_arrays([*own, *[pa.array(x, arrow.field(n + k).type) for k, x in enumerate(zip(*rows, strict=True))]], schema=arrow)

            for at, given in enumerate(zip(*[batch.column(n + i).to_pylist() for i in range(len(inputs))], strict=True)):
                found = iter(fn(*given))
                while got := list(islice(found, MOST_ROWS - len(rows))):
                    owners.append((at, len(got)))
                    rows += got
                    if len(rows) >= MOST_ROWS:
                        yield sent()
                        owners, rows = [], []
            if rows:
                yield sent()

    return src.mapInArrow(run, out).toDF(*keep, *new.names)


def rows_of_parts(df: DataFrame, inputs: list[str], fn: Callable[[list[list]], list[tuple]], made: str) -> DataFrame:
    """Rows that fn makes of each part of a batch, columns `made` (DDL): sums over many rows, to be added up."""
    new = StructType.fromDDL(made)
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, list(range(len(inputs))))):
            rows = fn([c.to_pylist() for c in batch.columns])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, arrow.field(k).type) for k, x in enumerate(zip(*rows, strict=True))], schema=arrow)

    return df.select(*inputs).mapInArrow(run, new)
