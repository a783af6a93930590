"""Parsed rows to staging tables, and the checks on the way."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

PARTITIONS = ("PROC_DATE", "BRANCH_CODE")
#: The map of inferred columns, and the folder that holds each table's column names.
CELLS, COLUMNS = "cells", "_COLUMNS"
SHADOW_TABLES = ("DEP_SHADOW_FILE", "LOAN_SHADOW_FILE")
BRANCH_COLUMNS = ("HEAD_OFFICE", "REGIONAL_OFFICE", "BRANCH_NAME", "DISTRICT", "ADDRESS", "CONTACT_NO", "BRANCH_CODE")
# Fixed value: column width of the reference's staging tables; longer text is reported, never cut.
TEXT_WIDTH = 500


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalize(df: DataFrame) -> DataFrame:
    """Outer blanks off every text column; empty text becomes NULL."""
    return df.withColumns({c: F.nullif(strip(F.col(c)), F.lit("")) for c in _text_columns(df)})


def validate(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Adds ``errors`` (messages) and ``is_valid``."""
    checks = [
        F.when(F.col(c).isNull(), F.lit(f"Field '{c}' is required but missing")) if c in df.columns
        else F.lit(f"Field '{c}' is required but missing")
        for c in required or []
    ]
    empty = F.lit(True)
    for c in df.columns:
        empty = empty & F.col(c).isNull()
    errors = F.array_compact(F.array(F.when(empty, F.lit("Record is empty")), *checks))
    return df.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def too_wide(df: DataFrame, width: int = TEXT_WIDTH) -> DataFrame:
    """(column_name, rows): how many values are longer than the reference's columns."""
    wide = df.agg(*[F.count_if(F.length(c) > width).alias(c) for c in _text_columns(df)])
    return wide.unpivot([], wide.columns, "column_name", "rows").filter("rows > 0")


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Same columns for every file of a table: absent ones empty, ``id`` renamed ``original_id``."""
    named = df.withColumnsRenamed({c: "original_id" for c in df.columns if c.lower() == "id"})
    wanted = ["original_id" if c.lower() == "id" else c for c in columns]
    return named.select(*[
        F.coalesce(F.col(c), F.lit("")).alias(c) if c in named.columns else F.lit("").alias(c) for c in wanted])


def stage(df: DataFrame, root: str, table: str) -> None:
    """Replace exactly the (date, branch) pairs present in the rows, whatever file they came from.

    Shadow files carry neither; there the file is the unit of replacement. The rebalance hint
    lets a pair with very many rows be written by several tasks. A table of no rows yet is there too, with its columns: the
    names are kept beside the table, those of inferred columns from the rows' own.
    """
    keys = ["source_file"] if table in SHADOW_TABLES else list(PARTITIONS)
    (
        df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys).parquet(f"{root}/{table}")
    )
    if CELLS in df.columns:
        # Files of a layout have few different lists of names.
        names = df.select(F.map_keys(CELLS).alias("names")).distinct().select(F.explode("names").alias("name")).distinct()
    else:
        names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    known = _known_columns(df.sparkSession, root, table)
    new = names if known is None else names.join(known, "name", "left_anti")
    if known is None or new.limit(1).count():
        new.coalesce(1).write.mode("append").parquet(f"{root}/{COLUMNS}/{table}")


def _known_columns(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    try:
        return spark.read.schema("name string").parquet(f"{root}/{COLUMNS}/{table}")
    except AnalysisException:
        return None


def read_staged(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Partition values stay text (``00001`` is not 1); blank ones are stored as NULL and read as empty. Inferred columns
    are flat columns, empty where a file does not have them; a table that was staged without rows is empty."""
    path = f"{root}/{table}"
    known = _known_columns(spark, root, table)
    names = sorted(r.name for r in known.distinct().collect()) if known is not None else []  # columns of one table
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException:
        if not names:
            raise
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    # Partition columns come last, in partition order; a table stored flat keeps its columns as they are.
    keys = next((k for k in (list(PARTITIONS), ["source_file"]) if found.names[-len(k):] == k), [])
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in keys else f for f in found.fields])
    rows = spark.read.schema(schema).parquet(path).withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in keys})
    # A column that is named like one of the file's own (branch, date) keeps the file's value where the row has none.
    return widen(rows, [n for n in names if n.upper() not in map(str.upper, rows.columns)]) if CELLS in rows.columns else rows


def widen(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the named columns as flat ones, from the map of inferred columns where there is one; absent ones are empty."""
    if CELLS not in df.columns:
        return df.withColumns({c: F.lit("") for c in columns if c not in df.columns})
    named = {c: F.coalesce(F.try_element_at(CELLS, F.lit(c)), F.lit("")) for c in columns}
    return df.withColumns(named).drop(CELLS)


def read_branch_seed(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Branch network from JSON lines, read in splits; ``array``: from files that are one JSON array each, such as a seed of
    some hundred branches."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in BRANCH_COLUMNS])
    return spark.read.schema(schema).option("multiLine", array).json(path)


def write_branch_seed(network: DataFrame, path: str) -> None:
    """One JSON object a line."""
    network.select(*BRANCH_COLUMNS).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Header, every value quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def row_counts(tables: dict[str, DataFrame], branch: str = "ALL") -> DataFrame:
    """(table_name, records) of the tables that have rows for the branch."""
    out = None
    for name, df in tables.items():
        column = next((c for c in ("BRANCH_CODE", "BRANCH") if c in df.columns), None)
        rows = df.filter(F.col(column) == branch) if branch != "ALL" and column else df
        one = rows.agg(F.count("*").alias("records")).select(F.lit(name).alias("table_name"), "records")
        out = one if out is None else out.unionByName(one)
    return out.filter("records > 0")
