"""Report id, branch and date of each file, from its first 20 and last 50 lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

FIELDS = ("REPORT_ID", "BRANCH_CODE", "BRANCH_NAME", "PROC_DATE")
HEAD_LINES, TAIL_LINES, TITLE_LINES = 20, 50, 30

# Header patterns of the reports.
_REPORT_ID = r"(?i)REPORT[- ]?ID\s*:\s*([A-Z0-9\-]+)"
_DATE = r"(\d{2}/\d{2}/\d{4})"
_BRANCH = r"(?i)BRANCH[- _]?(?:NO|CODE)?\.?\s*:?-?\s*(\d+)"
_BRANCH_PLAIN = r"(?i)BRANCH\s*:\s*(\d+)"
_NAME = r"(?i)BRANCH[- ]?NAME\s*:?-?\s*([A-Za-z0-9&.,() ]+?)(?:\s{2,}|$)"
_NAME_PLAIN = r"(?i)BRANCH\s*:\s*\d+\s+([A-Za-z0-9&.,() ]+?)(?:\s{2,}|$)"
_HEAD_OFFICE_CODE, _HEAD_OFFICE_NAME = "00001", "HEAD OFFICE"
_SHARED_ID = "BR2482-01"
_TITLES = {"BR2482-02": "LOGGED ON BUT NO TRANSACTIONS", "BR2482-03": "TERMINALS NOT LOGGED ON"}


def _found(line: Column, pattern: str) -> Column:
    return F.nullif(strip(F.regexp_extract(line, pattern, 1)), F.lit(""))


def line_fields(line: Column) -> dict[str, Column]:
    """What a single line says about its file (NULL where it says nothing)."""
    return {
        "REPORT_ID": F.upper(_found(line, _REPORT_ID)),
        "PROC_DATE": F.when(F.upper(line).contains("DATE"), _found(line, _DATE)),
        "BRANCH_CODE": F.coalesce(_found(line, _BRANCH), _found(line, _BRANCH_PLAIN)),
        "BRANCH_NAME": F.coalesce(_found(line, _NAME), _found(line, _NAME_PLAIN)),
    }


def extract_metadata(lines: DataFrame) -> DataFrame:
    """(path, REPORT_ID, BRANCH_CODE, BRANCH_NAME, PROC_DATE, line_count); empty text when absent.

    Only per-file summaries and the few speaking lines are shuffled; a file is never gathered.
    """
    title = F.upper("line")
    sizes = lines.groupBy("path").agg(
        (F.max("line_no") + 1).alias("line_count"),
        *[F.max(F.when(F.col("line_no") < TITLE_LINES, title.contains(text))).alias(rid) for rid, text in _TITLES.items()],
    )
    # Two words are enough to skip most lines before any pattern is tried.
    speaking = lines.filter(title.contains("REPORT") | title.contains("BRANCH") | title.contains("DATE"))
    speaking = speaking.select("path", "line_no", *[c.alias(n) for n, c in line_fields(F.col("line")).items()])
    speaking = speaking.filter(F.coalesce(*[F.col(n) for n in FIELDS]).isNotNull())
    near_edge = (F.col("line_no") < HEAD_LINES) | (F.col("line_no") >= F.col("line_count") - TAIL_LINES)
    first = speaking.join(sizes.select("path", "line_count"), "path").filter(near_edge).groupBy("path").agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in FIELDS]
    )
    found = sizes.join(first, "path", "left").select(
        "path", "line_count", *_TITLES, *[F.coalesce(n, F.lit("")).alias(n) for n in FIELDS]
    )
    name = F.when((F.col("BRANCH_NAME") == "") & (F.col("BRANCH_CODE") == _HEAD_OFFICE_CODE),
                  _HEAD_OFFICE_NAME).otherwise(F.col("BRANCH_NAME"))
    rid = F.col("REPORT_ID")
    for special in reversed(_TITLES):
        rid = F.when((F.col("REPORT_ID") == _SHARED_ID) & F.col(special), special).otherwise(rid)
    return found.withColumns({"BRANCH_NAME": name, "REPORT_ID": rid}).select("path", *FIELDS, "line_count")


def attach(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds the four file columns; a branch found inside the file overrides the header's."""
    own = [c for c in FIELDS if c in rows.columns]
    renamed = rows.withColumnsRenamed({c: f"_own_{c}" for c in own})
    joined = renamed.join(metadata.select("path", *FIELDS), "path", "left")
    for c in FIELDS:
        value = F.coalesce(F.nullif(F.col(f"_own_{c}"), F.lit("")), F.col(c)) if c in own else F.col(c)
        joined = joined.withColumn(c, F.coalesce(value, F.lit("")))
    return joined.drop(*[f"_own_{c}" for c in own])
