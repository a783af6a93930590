"""Constraint checks as frames of violations; an empty frame means the load may go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The allowed codes of the warehouse columns.
ALLOWED = {
    "ACCOUNT_CATEGORY": ("DEPOSIT", "LOAN", "CC_OD"),
    "EXCEPTION_TYPE": (
        "TXN_LIMIT_BREACH", "INT_RATE_VARIANCE", "HIGH_VALUE_TXN", "LIEN_OPERATION",
        "BGL_AGING", "DEBIT_INCOME_ACCT", "CREDIT_EXPENSE_ACCT", "OTHER",
    ),
    "SEVERITY": ("LOW", "MEDIUM", "HIGH", "CRITICAL"),
    "ACCESS_ROLE": ("HO", "RO", "BRANCH"),
    "STATUS": ("RUNNING", "SUCCESS", "FAILED", "PARTIAL"),
}


def code_violations(df: DataFrame, column: str, allowed=None) -> DataFrame:
    """Values outside the allowed list with their row counts (NULL passes, as in a check constraint)."""
    values = allowed or ALLOWED[column]
    return (
        df.filter(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("rows")).withColumn("column_name", F.lit(column))
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def missing_list(required: list[str]) -> Column:
    """The required columns that are NULL, comma-separated; empty where the row is complete."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return F.array_join(gaps, ",")


def missing_values(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows lacking a required value, with the list of the missing columns."""
    return df.withColumn("missing", missing_list(required)).filter("missing <> ''")


def split_missing(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rows for the quarantine table)."""
    return df.dropna(subset=required), missing_values(df, required)


class LoadRejected(ValueError):
    """A load broke a key or not-null rule; nothing was written."""


def require_empty(violations: DataFrame, what: str) -> None:
    sample = violations.limit(5).collect()
    if sample:
        raise LoadRejected(f"{what}: {[r.asDict() for r in sample]}")
