"""Analysis of streams: the same Arrow pass on a streaming DataFrame, stateless, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..analyzer import Analyzer
from ..sources.corpus import result_lines


def analyze_stream(lines: DataFrame, analyzer: Analyzer, text: str = "value", options: str | None = None) -> DataFrame:
    """A streaming (or batch) DataFrame with the words of its text column; every row is a sentence of its own."""
    return analyzer.analyze(lines, text, options)


def analyze_files(spark: SparkSession, analyzer: Analyzer, source: str, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Analyses the lines of text files as they arrive under source, into text files under target. once: those there now, then ends.

    checkpoint must be a folder that all executors share; with it each file is analysed once, whatever is lost.
    """
    lines = spark.readStream.text(source)
    out = analyze_stream(lines, analyzer).select(result_lines(F.col("words")).alias("value"))
    writer = out.writeStream.format("text").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
