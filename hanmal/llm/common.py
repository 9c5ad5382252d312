"""What the corpus operators share: scratch tables, byte-bounded batches, repeat-safe ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker turns into arrays at once.
CHUNK_CHARS = 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    In local mode with nothing set, a temporary folder is chosen and set. On a cluster an unset folder is an error,
    as no folder of one machine would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="hanmal-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{scratch_dir(spark)}/hanmal-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes every table that this application wrote into the shared folder; results that were not written yet can't be read any more."""
    delete(spark, run_dir(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet into the shared folder and reads it back, which cuts its lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize() that no later plan reads."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, f)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that df does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever characters their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def map_rows(df: DataFrame, columns: list, fn: Callable[[list[list]], dict], schema: str) -> DataFrame:
    """df's columns through fn, a few megabytes of text at a time.

    fn gets one Python list per column (the last is the text that bounds a chunk) and returns columns by name; it need
    not return as many rows as it got.
    """
    src = df.select(*columns)
    out = spark_to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                got = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([as_arrow(got[f.name], f.type) for f in out], schema=out)

    return src.mapInArrow(run, schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def spark_to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def chunks(batch: pa.RecordBatch, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose last column holds about `most` bytes each; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def fingerprint() -> Column:
    """Tells rows apart that share a doc_id but not a text."""
    return F.xxhash64(F.col("text"))


#: Words of 64 bits in a membership sketch, which bounds what is broadcast for it: 2**18 rows of 16 bytes.
SKETCH_WORDS = 1 << 18


def maybe_among(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """df's rows whose key may be among the long column `k` of wanted, none of those left out.

    wanted is reduced to a blocked Bloom filter of SKETCH_WORDS words, three bits a key. It is of this size for any input, so
    it can be broadcast; for more keys than it can tell apart it lets more rows through, and the exact join that follows
    has more to do.
    """
    word = lambda k: F.pmod(F.xxhash64(k), F.lit(SKETCH_WORDS))
    bit = lambda k, seed: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(64)).cast("int"))
    mask = lambda k: bit(k, 1).bitwiseOR(bit(k, 2)).bitwiseOR(bit(k, 3))
    at, bits = unused(df, "word", "mask")
    sketch = wanted.groupBy(word(F.col("k")).alias(at)).agg(F.bit_or(mask(F.col("k"))).alias(bits))
    hit = (word(key) == F.col(at)) & (mask(key).bitwiseAND(F.col(bits)) == mask(key))
    return df.join(F.broadcast(sketch), hit, "left_semi")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_label(labels: DataFrame) -> DataFrame:
    """doc_id, quality, toxic: of several labels of one document the lowest quality and the highest toxic; none without a doc_id or quality."""
    worst = [F.min("quality").alias("quality"), *[F.max("toxic").alias("toxic")] * ("toxic" in labels.columns)]
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(*worst)
