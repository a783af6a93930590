"""Table explorer: search, branch filter, numeric order of text, one page."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from . import lineage
from . import scope as sc

# Columns hidden in the explorer, default order columns.
HIDDEN = ("ID", "SR_NO")
ORDER_PRIORITY = (
    "CURRENT_BALANCE", "BAL_OUTSTAND", "TOTAL_OUTSTANDING", "OUTSTANDING", "TOTAL_AMOUNT", "AMOUNT",
    "BALANCE", "DR_BALANCE", "CR_BALANCE", "NPA", "VALUE",
)


def matching_rows(df: DataFrame, branch: str = "ALL", text: str = "") -> DataFrame:
    shown = df.select(*[c for c in df.columns if c.upper() not in HIDDEN])
    if branch != "ALL" and "BRANCH_CODE" in shown.columns:
        shown = shown.filter(F.col("BRANCH_CODE") == branch)
    return sc.search(shown, text)


def order_column(columns: list[str], asked: str = "") -> str:
    by_upper = {c.upper(): c for c in columns}
    if asked.upper() in by_upper:
        return by_upper[asked.upper()]
    return next((by_upper[p] for p in ORDER_PRIORITY if p in by_upper), columns[0])


#: Rows that a page and all before it may have to be found by a bounded top-k; further pages are found in a sorted copy.
DEEP = 10_000


def _order(columns: list[str], sort_by: str, descending: bool) -> list[tuple[Column, bool]]:
    """The order key and, for ties, all columns, each with its direction."""
    return [(numbers.sortable(order_column(columns, sort_by)), descending), *[(F.col(c), False) for c in columns]]


def _sorts(order: list[tuple[Column, bool]]) -> list[Column]:
    return [key.desc_nulls_last() if down else key.asc_nulls_first() for key, down in order]


def page(df: DataFrame, branch: str = "ALL", text: str = "", sort_by: str = "", descending: bool = False,
         number: int = 1, size: int = 50, deep: int = DEEP) -> DataFrame:
    """One page of the matching rows, of the size asked for, with the total of all matches on each row.

    A page among the first ``deep`` rows is a bounded top-k. To jump further, the rows are sorted once into a stored copy, whose
    files follow one another: the rows of each file are counted, and the page is read from the files that hold it.
    """
    rows = matching_rows(df, branch, text)
    order = _sorts(_order(rows.columns, sort_by, descending))
    first, size = max(0, (number - 1) * size), max(1, size)
    if first + size <= deep:
        return rows.orderBy(*order).offset(first).limit(size).withColumn("total_records", rows.agg(F.count("*")).scalar())
    return _from_sorted(rows, order, first, size)


def _from_sorted(rows: DataFrame, order: list[Column], first: int, size: int) -> DataFrame:
    spark = rows.sparkSession
    path = f"{lineage.shared_folder(spark)}/sorted/{uuid.uuid4().hex}"
    rows.orderBy(*order).write.parquet(path)
    copy = spark.read.schema(rows.schema).parquet(path)
    name, place = copy.metadataColumn("_metadata")["file_name"], copy.metadataColumn("_metadata")["row_index"]
    files = copy.groupBy(name.alias("_file")).agg(F.count("*").alias("_n"))
    # One row a file; names carry the number of the sorted partition.
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    held = files.filter((F.col("_before") < first + size) & (F.col("_before") + F.col("_n") > first)).collect()
    total = files.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    on_page = F.lit(False)
    for f in held:  # the files that a page lies in
        on_page = on_page | ((name == f["_file"]) & place.between(max(0, first - f["_before"]), first + size - f["_before"] - 1))
    return copy.filter(on_page).orderBy(*order).withColumn("total_records", total)


def page_after(df: DataFrame, last: dict | None, branch: str = "ALL", text: str = "", sort_by: str = "", descending: bool = False,
               size: int = 50) -> DataFrame:
    """The ``size`` matching rows that follow the row ``last`` (a row of the page before, None for the first page): a bounded top-k
    however far the reader has come. Rows equal in all columns are shown as one page boundary at most."""
    rows = matching_rows(df, branch, text)
    order = _order(rows.columns, sort_by, descending)
    if last is not None:
        cursor = df.sparkSession.createDataFrame([tuple(last[c] for c in rows.columns)], rows.schema)
        key = numbers.sortable(order_column(rows.columns, sort_by))
        values = [cursor.agg(F.first(key)).scalar(), *[cursor.agg(F.first(c)).scalar() for c in rows.columns]]
        beyond, equal = F.lit(False), F.lit(True)
        for (column, down), value in zip(order, values, strict=True):
            # NULL is the last value downwards and the first upwards.
            after = (column < value) | (column.isNull() & value.isNotNull()) if down else (column > value) | (column.isNotNull() & value.isNull())
            beyond = beyond | (equal & F.coalesce(after, F.lit(False)))
            equal = equal & column.eqNullSafe(value)
        rows = rows.filter(beyond)
    return rows.orderBy(*_sorts(order)).limit(max(1, size))
