"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import line_dedup, mil_quality, mixing, packing, quality_rules, secret_scan, simhash, substring_dedup, telephony, warc
from .common import fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score from its attention-weighted passages, and whether to keep it."""
    return mil_quality.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, domain posteriors, fitted rate and copies drawn."""
    return mixing.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("fp")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without lines that repeat an earlier one."""
    return line_dedup.apply(table(spark, sf_dir, "documents"), short_copies=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for its group of near-duplicates, and the group's size."""
    return simhash.classes(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's length bucket, batch and slot."""
    return packing.apply(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, archived, indexed, and read back by byte range."""
    files = warc.write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc.fetch(warc.build_index(spark, files))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every literal that is assigned to a sensitive name."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass the risk-controlled rules."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.apply(docs, labels).drop("text")


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled PCM of the recordings that documents stand in for."""
    return telephony.apply(spark, sf_dir)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage: its document and offsets, and the document that keeps it."""
    return substring_dedup.repeats(table(spark, sf_dir, "documents")).drop("fp")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mil_quality, op2_mixing, op3_line_dedup, op4_simhash, op5_packing, op6_warc, op7_secret_scan, op8_quality_rules, op9_telephony, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op6_warc": "SELECT page_id, url, html, CASE WHEN html IS NOT NULL THEN 'sha1:' || sha1(html) END AS digest FROM pages",
}
