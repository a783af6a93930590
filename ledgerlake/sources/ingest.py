"""A nightly folder to staging tables in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage
from . import files, metadata, routing, staging
from .layouts import INFERRED, LAYOUTS


def parse(lines: DataFrame, layout: str) -> DataFrame:
    """Rows of one layout; inferred columns come as a map (see ``staging.widen``)."""
    return (LAYOUTS.get(layout) or INFERRED[layout])(lines)


def routed_files(lines: DataFrame) -> DataFrame:
    """One row per file: metadata, route and layout."""
    meta = metadata.extract_metadata(lines)
    return routing.route(meta.join(routing.shadow_lengths(lines), "path", "left"))


def tables(lines: DataFrame, routed: DataFrame, layouts: list[str]) -> dict[str, DataFrame]:
    """Staging rows per layout. ``lines`` should be stored by layout (see ``ingest``)."""
    out = {}
    for layout in layouts:
        mine = lines.filter(F.col("layout") == layout).select("path", "line_no", "line")
        rows = parse(mine, layout)
        if layout not in staging.SHADOW_TABLES:
            rows = _attach(rows, routed)
        rows = rows.withColumn("source_file", files.file_name(F.col("path")))
        out[layout] = staging.align(rows, rows.columns) if layout in LAYOUTS else rows
    return out


def _judged(rows: DataFrame, layout: str, work: str) -> tuple[DataFrame, DataFrame]:
    """The rows to stage, and of each file how many these are and how many another file has superseded. ``rows`` are stored; they are
    counted by file, date and branch, and only those few counts are compared. Superseded rows lie apart, in ``work``."""
    spark = rows.sparkSession
    keys = ["path"] if layout in staging.SHADOW_TABLES else ["path", *staging.PARTITIONS]
    rows.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{work}/counted/{layout}")
    found = spark.read.schema(", ".join([*[f"{k} string" for k in keys], "n bigint"])).parquet(f"{work}/counted/{layout}")
    judged = found.withColumn(SUPERSEDED, F.lit(False)) if layout in staging.SHADOW_TABLES else _one_file_per_pair(found)
    one = lambda hit, name: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0).cast("bigint")).alias(name)
    counts = judged.groupBy("path").agg(one(~F.col(SUPERSEDED), "staged"), one(F.col(SUPERSEDED), "superseded"))
    gone = judged.filter(SUPERSEDED).select(*keys)
    some = gone.limit(1).count() > 0
    (rows.join(gone, keys, "left_semi") if some else rows.limit(0)).write.mode("overwrite").parquet(f"{work}/{SUPERSEDED}/{layout}")
    return rows.join(gone, keys, "left_anti").select(*rows.columns) if some else rows, counts


def _attach(rows: DataFrame, routed: DataFrame) -> DataFrame:
    full = metadata.attach(rows, routed)
    if "_known_name" in full.columns:
        name = F.coalesce(F.nullif(F.col("BRANCH_NAME"), F.lit("")), F.col("_known_name"))
        full = full.withColumn("BRANCH_NAME", name).drop("_known_name")
    return full


SUPERSEDED = "superseded"
#: Bytes of a row group of stored lines. Lines pack to a few bytes each and take long to parse, and a row group is read by one task.
LINE_GROUP = 2 * 2**20


def _one_file_per_pair(rows: DataFrame) -> DataFrame:
    """Adds ``superseded``: of several files with rows for one (date, branch), the last by path replaces the others. Where date or
    branch is blank, nothing says that two files are the same report, so all rows stay."""
    known = [F.trim(F.col(c)) != "" for c in staging.PARTITIONS]
    owner = rows.filter(known[0] & known[1]).groupBy(*staging.PARTITIONS).agg(F.max("path").alias("_last"))
    judged = rows.join(owner, list(staging.PARTITIONS), "left")
    return judged.select(*rows.columns, F.coalesce(F.col("_last") != F.col("path"), F.lit(False)).alias(SUPERSEDED))


def ingest(spark: SparkSession, folder: str, root: str, work: str, limit: int = files.BINARY_LIMIT) -> DataFrame:
    """Read, route, parse and stage a folder; returns per-file outcomes (layout NULL = skipped) with the rows of each
    file that were staged and that another file of the same date and branch has superseded.

    Lines are written once, by layout, so that each parser reads only its own files and a lost
    executor never causes the folder to be decoded again. ``work`` is a shared folder.
    """
    lines, failed = files.read_reports(spark, folder, work, limit)
    return ingest_lines(spark, lines, root, work).unionByName(
        failed.select("path", "error"), allowMissingColumns=True)


def ingest_lines(spark: SparkSession, lines: DataFrame, root: str, work: str, settled: bool = False) -> DataFrame:
    """``settled``: the lines are read from stored files, so they are not stored once more before they are dealt to their layouts."""
    with lineage.freed(spark):
        return _ingested(spark, lines, root, work, settled)


def _ingested(spark: SparkSession, lines: DataFrame, root: str, work: str, settled: bool) -> DataFrame:
    if not settled:
        lines.write.mode("overwrite").parquet(f"{work}/lines")
        lines = spark.read.parquet(f"{work}/lines")
    routed_files(lines).write.mode("overwrite").parquet(f"{work}/files")
    routed = spark.read.parquet(f"{work}/files")
    # A task reads the lines of a few files, hence of few layouts: they go to their folders without a shuffle.
    split = lines.join(routed.filter("layout IS NOT NULL").select("path", "layout"), "path")
    split.write.mode("overwrite").option("parquet.block.size", LINE_GROUP).partitionBy("layout").parquet(f"{work}/by_layout")
    # At most one name per layout comes to the driver.
    present = [r.layout for r in routed.select("layout").filter("layout IS NOT NULL").distinct().collect()]
    counts = spark.createDataFrame([], "path string, staged bigint, superseded bigint")
    if present:
        by_layout = spark.read.parquet(f"{work}/by_layout")
        for name, df in tables(by_layout, routed, sorted(present)).items():
            # Parsed once: which file comes last is asked of the stored rows.
            df.write.mode("overwrite").parquet(f"{work}/attached/{name}")
            rows, counted = _judged(spark.read.schema(df.schema).parquet(f"{work}/attached/{name}"), name, work)
            staging.stage(rows, root, name)
            counts = counts.unionByName(counted)
    outcome = routed.select("path", "REPORT_ID", "layout", F.lit(None).cast("string").alias("error")).join(counts, "path", "left")
    return outcome.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("staged", "superseded")})
