"""Branch and period scopes.

The newest day of a table enters as an uncorrelated scalar subquery, so it is computed once on
the cluster and, on a date-partitioned table, prunes files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleanse

# Period names in days, and the tables whose ALL means the newest day.
PERIOD_DAYS = {"7D": 7, "15D": 15, "30D": 30, "90D": 90, "6M": 180, "1Y": 365, "YTD": 365}
SNAPSHOT_TABLES = (
    "DEPOSITS_BALANCE_FILE_DEPD0586",
    "BAL_IN_LOAN_ACC_GLCC_WISE_DET",
    "LIST_OF_NPA_ACCOUNTS",
    "DAILY_PRODUCTWISE_REPORT_LOAN_DEP_CLEARING_GNBD7376",
)
REGION_PREFIX = "REGION:"


def day_of(df: DataFrame, column: str) -> Column:
    """The column as a date, parsed when it is report text."""
    return F.col(column) if isinstance(df.schema[column].dataType, T.DateType) else cleanse.date(column)


def newest_day(df: DataFrame, column: str = "PROC_DATE") -> Column:
    """Report text is parsed once for each value that occurs, not for each row."""
    days = df if isinstance(df.schema[column].dataType, T.DateType) else df.select(column).distinct()
    return days.agg(F.max(day_of(days, column))).scalar()


def in_branch(df: DataFrame, scope: str | None = "ALL", network: DataFrame | None = None,
              column: str = "BRANCH_CODE") -> DataFrame:
    """ALL or empty keeps everything, ``REGION:x`` the branches of a region, else one branch."""
    if not scope or scope == "ALL":
        return df
    if scope.startswith(REGION_PREFIX):
        members = (
            network.filter(F.col("REGIONAL_OFFICE") == scope[len(REGION_PREFIX):])
            .select(F.col("BRANCH_CODE").alias(column)).distinct()
        )
        return df.join(members, column, "left_semi")
    return df.filter(F.col(column) == scope)


def in_period(df: DataFrame, period: str | None = "ALL", start: str | None = None, end: str | None = None,
              table: str | None = None, column: str = "PROC_DATE") -> DataFrame:
    """Explicit range, explicit day, ISO day, or a number of days up to the table's newest day."""
    day = day_of(df, column)
    if start and end:
        return df.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if start:
        return df.filter(day == F.lit(start).cast("date"))
    if not period or period == "ALL":
        return df.filter(day == newest_day(df, column)) if table in SNAPSHOT_TABLES else df
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", period):
        return df.filter(day == F.lit(period).cast("date"))
    if period in PERIOD_DAYS:
        return df.filter(day >= F.date_sub(newest_day(df, column), PERIOD_DAYS[period]))
    return df


def scoped(df: DataFrame, table: str | None = None, scope: str | None = "ALL", network: DataFrame | None = None,
           period: str | None = "ALL", start: str | None = None, end: str | None = None,
           column: str = "PROC_DATE", branch: str = "BRANCH_CODE") -> DataFrame:
    """Period first: its newest day is that of the whole table, not of the branch."""
    return in_branch(in_period(df, period, start, end, table, column), scope, network, branch)


def report_day(df: DataFrame, day: str | None = None, column: str = "SNAPSHOT_DATE") -> Column:
    """The asked-for day, else the newest day of the fact table."""
    return F.lit(day).cast("date") if day else newest_day(df, column)


def key_present(column: str) -> Column:
    return F.trim(F.col(column)) != ""


def only_day(df: DataFrame, day: str | None, column: str = "SNAPSHOT_DATE") -> DataFrame:
    """Incremental filter, added only when a day is given."""
    return df if day is None else df.filter(F.col(column) == F.lit(day).cast("date"))


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where any text column contains the text, ignoring case; % and _ are literal."""
    if not text:
        return df
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    hit = F.lit(False)
    for name in names:
        hit = hit | F.contains(F.lower(F.col(name)), F.lower(F.lit(text)))
    return df.filter(F.coalesce(hit, F.lit(False)))


def group_label(df: DataFrame, scope: str | None, network: DataFrame | None, branch: str = "BRANCH_CODE") -> DataFrame:
    """Adds ``group_name``: the regional office when looking at ALL, else the branch name."""
    if scope and scope != "ALL":
        return df.withColumn("group_name", F.col("BRANCH_NAME"))
    offices = network.select(F.col("BRANCH_CODE").alias(branch), F.col("REGIONAL_OFFICE").alias("_office"))
    return (
        df.join(offices, branch, "left")
        .withColumn("group_name", F.coalesce("_office", F.lit("Unknown Region"))).drop("_office")
    )
