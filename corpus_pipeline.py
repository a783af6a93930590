"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. ``run`` writes each stage's
result as Parquet to the shared folder and reads it again, so a lost executor repeats one stage at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import curve_packing, jaccard_join, line_dedup, quality_rules, secret_scan
from ledgerlake.llm.common import stored
from ledgerlake.llm.queries import WORD_BPE


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing is left."""
    return _counted(line_dedup.deduplicated(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return jaccard_join.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return _counted(secret_scan.redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the training sequences."""
    pieces = curve_packing.packed(docs, WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", rules), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("packing", packing)]

#: Near-duplicate classes, winnowed runs and byte-pair ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
