"""Commands: python -m hanmal analyze --resources FOLDER --input PATH --output PATH [--errpatch] [--options JSON]; stream; evaluate; version."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import version


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hanmal")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="analyse the lines of text files")
    a.add_argument("--errpatch", action="store_true", help="write the tags before error patches instead, as JSON lists")
    s = sub.add_parser("stream", help="analyse text files as they arrive")
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--once", action="store_true")
    for x in (a, s):
        x.add_argument("--resources", required=True)
        x.add_argument("--input", required=True)
        x.add_argument("--output", required=True)
        x.add_argument("--options", default=None, help="JSON object of preanal, errpatch, restore")
    e = sub.add_parser("evaluate", help="precision, recall and F-score of an analysed file against a gold one")
    e.add_argument("--gold", required=True)
    e.add_argument("--pred", required=True)
    sub.add_parser("version")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from .analyzer import Analyzer
    from .operators import evaluate
    from .sources import corpus
    from .streaming import analyze_files

    o = parser().parse_args(args)
    if o.command == "version":
        print(version())
        return
    spark = spark or SparkSession.builder.appName("hanmal").getOrCreate()
    if o.command == "analyze":
        lines, analyzer = spark.read.text(o.input), Analyzer.open(o.resources)
        if o.errpatch:
            analyzer.tags_before_patch(lines, "value", o.options).select(F.to_json("tags").alias("value")).write.text(o.output)
        else:
            corpus.write_results(analyzer.analyze(lines, "value", o.options), o.output)
    elif o.command == "stream":
        analyze_files(spark, Analyzer.open(o.resources), o.input, o.output, o.checkpoint, o.once).awaitTermination()
    else:
        gold, pred = (corpus.eval_words(corpus.read_lines(spark, x)).withColumn("file", F.lit(0)) for x in (o.gold, o.pred))
        key = ["file", "line_no"]
        if bad := evaluate.misaligned(gold, pred, key).limit(3).collect():
            sys.exit(f"the files do not hold the same words: {bad}")
        both = gold.withColumnRenamed("morphs", "gold").join(pred.select(*key, F.col("morphs").alias("pred")), key)
        print(evaluate.report(evaluate.morph_counts(both, key)).first()["report"])


if __name__ == "__main__":
    main()
