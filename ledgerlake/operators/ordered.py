"""State carried along the lines of a file, safe for one huge file.

A plain window over a file would put that file into one task. Lines are therefore cut into
blocks of consecutive numbers: state is carried inside each block in parallel, only the
last value of each block is carried from block to block, and the two are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_LINES = 50_000
PATH, LINE_NO = "path", "line_no"


def carry_forward(lines: DataFrame, values: dict[str, Column], block_lines: int = BLOCK_LINES) -> DataFrame:
    """Adds each value, filled down from the last line of the file where it was not NULL."""
    names = list(values)
    base = lines.withColumns(values).withColumn("_span", F.floor(F.col(LINE_NO) / block_lines))
    inside = Window.partitionBy(PATH, "_span").orderBy(LINE_NO)
    local = base.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in names})
    ends = base.groupBy(PATH, "_span").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(LINE_NO))).alias(f"_{n}") for n in names]
    )
    before = Window.partitionBy(PATH).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    entry = ends.select(
        PATH, "_span", *[F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in names]
    )
    return (
        local.join(entry, [PATH, "_span"], "left")
        .withColumns({n: F.coalesce(F.col(n), F.col(f"_in_{n}")) for n in names})
        .drop("_span", *[f"_in_{n}" for n in names])
    )


def after_marker(lines: DataFrame, marker: Column, nth: int = 1) -> DataFrame:
    """Lines below the n-th marker line of their file (files with fewer markers yield nothing)."""
    if nth == 1:
        gate = lines.filter(marker).groupBy(PATH).agg(F.min(LINE_NO).alias("_gate"))
    else:
        w = Window.partitionBy(PATH).orderBy(LINE_NO)
        gate = (
            lines.filter(marker).select(PATH, LINE_NO).withColumn("_n", F.row_number().over(w))
            .filter(F.col("_n") == nth).select(PATH, F.col(LINE_NO).alias("_gate"))
        )
    return lines.join(gate, PATH).filter(F.col(LINE_NO) > F.col("_gate")).drop("_gate")


def before_marker(lines: DataFrame, marker: Column) -> DataFrame:
    """Lines above the first marker line of their file; all lines when there is none."""
    stop = lines.filter(marker).groupBy(PATH).agg(F.min(LINE_NO).alias("_stop"))
    kept = lines.join(stop, PATH, "left")
    return kept.filter(F.col("_stop").isNull() | (F.col(LINE_NO) < F.col("_stop"))).drop("_stop")


def records(lines: DataFrame, first_line: Column, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Adds ``record``: the number of the line that opened the current record (none before the first)."""
    return carry_forward(lines, {"record": F.when(first_line, F.col(LINE_NO))}, block_lines).filter("record IS NOT NULL")


def nth_in_record(rows: DataFrame, k: int) -> DataFrame:
    """Adds ``nth`` (1..k), the line's place in its record; later lines are dropped before the shuffle."""
    w = Window.partitionBy(PATH, "record").orderBy(LINE_NO)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)
