"""Profiles of unknown tables: numeric columns, distinct counts, frequencies, branch roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name parts of identifier-like columns, and of columns never summed.
IDENTIFIER_PARTS = ("NAME", "ACCOUNT", "ACCT", "ID", "CHEQUE", "BRANCH", "PROC_DATE", "REPORT", "PAGENO")
NO_SUM_NAMES = (
    "ID", "NO", "SR_NO", "BR_NO", "ACCT_NO", "CUST_NO", "BRANCH_CODE", "BRANCH_NAME", "REPORT_ID", "PROC_DATE",
)
NO_SUM_PARTS = ("_ID", "ID_", "NO_", "_NO", "NUMBER", "CODE", "ACCT", "CUST", "DATE", "SYS", "NAME", "BR_")
JUNK_CHARS = "-=>*#_| "


def _text(name: str) -> Column:
    return F.trim(F.replace(F.col(name).cast("string"), F.lit(","), F.lit("")))


def _number(name: str) -> Column:
    return F.nullif(_text(name), F.lit("-")).try_cast("double")


def identifier_like(name: str) -> bool:
    return any(p in name.upper() for p in IDENTIFIER_PARTS)


def measure_like(name: str) -> bool:
    upper = name.upper()
    return upper not in NO_SUM_NAMES and not any(p in upper for p in NO_SUM_PARTS)


def column_metrics(df: DataFrame) -> DataFrame:
    """(column_name, kind, total, average) over whole tables: sums of columns that are numeric in
    over a tenth of the rows, distinct counts of identifier-like columns."""
    measures = [c for c in df.columns if c != "id" and not identifier_like(c)]
    keys = [c for c in df.columns if c != "id" and identifier_like(c)]
    parts = []
    if measures:
        wide = df.agg(
            F.count("*").alias("_rows"),
            *[F.sum(_number(c)).alias(f"s_{i}") for i, c in enumerate(measures)],
            *[F.count(_number(c)).alias(f"n_{i}") for i, c in enumerate(measures)],
        )
        long = wide.select("_rows", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"s_{i}").alias("total"), F.col(f"n_{i}").alias("_n"))
            for i, c in enumerate(measures)
        ])).alias("m")).select("_rows", "m.*")
        parts.append(long.filter("_n > _rows * 0.1").select(
            "column_name", F.lit("sum").alias("kind"), "total", (F.col("total") / F.col("_n")).alias("average")
        ))
    if keys:
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.trim(F.col(c).cast("string")).alias("v"),
                     F.coalesce(F.col(c).cast("string") != "", F.lit(False)).alias("ok")) for c in keys
        ])).alias("p")).select("p.*").filter("ok").select("column_name", "v").distinct()
        parts.append(pairs.groupBy("column_name").agg(F.count("*").cast("double").alias("total")).select(
            "column_name", F.lit("distinct").alias("kind"), "total", F.lit(0.0).alias("average")
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_category(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c != "id" and not identifier_like(c)), None)


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Row counts per trimmed value, without blank or purely decorative values."""
    value = F.trim(F.col(column).cast("string"))
    return (
        df.select(value.alias("value")).filter(F.translate("value", JUNK_CHARS, "") != "")
        .groupBy("value").agg(F.count("*").alias("rows"))
    )


def branch_metrics(df: DataFrame) -> DataFrame:
    """(BRANCH_CODE, BRANCH_NAME, metric, total): every summable column by branch.

    A column counts as numeric when most of its non-NULL values are numbers. One pass over
    the data; the choice of columns is made on the per-branch sums, inside the same plan.
    """
    names = [c for c in df.columns if measure_like(c)]
    rows = df.filter(F.col("BRANCH_CODE") != "")
    label = F.max("BRANCH_NAME") if "BRANCH_NAME" in df.columns else F.max(F.lit(None).cast("string"))

    def value(c: str) -> Column:
        return F.replace(F.col(c).cast("string"), F.lit(","), F.lit("")).try_cast("double")

    by_branch = rows.groupBy("BRANCH_CODE").agg(
        label.alias("BRANCH_NAME"),
        *[F.sum(value(c)).alias(f"s_{i}") for i, c in enumerate(names)],
        *[F.count(value(c)).alias(f"n_{i}") for i, c in enumerate(names)],
        *[F.count(F.col(c)).alias(f"k_{i}") for i, c in enumerate(names)],
    )
    long = by_branch.select("BRANCH_CODE", "BRANCH_NAME", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"s_{i}").alias("total"),
                 F.col(f"n_{i}").alias("_n"), F.col(f"k_{i}").alias("_k")) for i, c in enumerate(names)
    ])).alias("m")).select("BRANCH_CODE", "BRANCH_NAME", "m.*")
    numeric = long.groupBy("metric").agg(F.sum("_n").alias("n"), F.sum("_k").alias("k")).filter("n * 2 > k")
    return long.join(numeric.select("metric"), "metric", "left_semi").select(
        "BRANCH_CODE", "BRANCH_NAME", "metric", "total"
    )
