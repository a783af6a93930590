"""Loan risk and delinquency facts from seven overlapping reports.

The reference inserts the reports one after another, skipping accounts already there, and updates
rows in between. Here every row carries its report's place in that order, and one grouping by (date, account) picks the foremost
row and the updates: one wide shuffle instead of five anti joins and two update joins. Arrears
and drawing power enrich only the rows that were there when the reference applied them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleanse, labels
from ..operators import quality, scope
from .schemas import LOAN_RISK, conform

# The reports in order of precedence.
STATEMENT, NPA_LIST, PROBABLE, ARREARS = (
    "NPA_STMT", "LISTOF_NPA_ACCOUNTS_LOND2572", "PROBABLE_NPA_REPORT_LOND2463", "ARREARS_BREAK_UP_LOND2498")
DRAWING, IRREGULAR, EXCESS = "DRAWING_POWER_LOND2388", "LOAN_IRREGULAR_REPORT", "IRREGULAR_EXCESS_DRAW_LOND2397CPC"
PRECEDENCE = (STATEMENT, NPA_LIST, PROBABLE, ARREARS, IRREGULAR, EXCESS)
PLACE = {table: i for i, table in enumerate((*PRECEDENCE, DRAWING))}
KEYS = ["SNAPSHOT_DATE", "ACCOUNT_NO"]
DRAWING_VALUES = ("DRAWING_POWER", "DP_VARIANCE", "OUTSTANDING", "BENCHMARK_LEVEL", "TOLERANCE_LEVEL")
SLABS = ("ARREARS_1D_28D", "ARREARS_29D_3M", "ARREARS_3M_6M", "ARREARS_6M_1Y", "ARREARS_1Y_3Y")
LONG_SLABS = ("ARREARS_3Y_5Y", "ARREARS_5Y_7Y", "ARREARS_7Y_10Y", "ARREARS_10Y_15Y", "ARREARS_15Y_ABOVE")


def _rows(rows: DataFrame, account: str, source: str, day: str | None, columns: dict[str, Column],
          branch: str = "BRANCH_CODE", probable: bool = False, confirmed: bool = False) -> DataFrame:
    picked = rows.filter(scope.key_present(account)).select(
        cleanse.date("PROC_DATE").alias("SNAPSHOT_DATE"), cleanse.account_no(account).alias("ACCOUNT_NO"),
        cleanse.branch_code(branch).alias("BRANCH_CODE"), F.lit(probable).alias("IS_PROBABLE_NPA"),
        F.lit(confirmed).alias("IS_CONFIRMED_NPA"), F.col("REPORT_ID").alias("SOURCE_REPORT_ID"),
        F.lit(source).alias("SOURCE_TABLE"), *[c.alias(n) for n, c in columns.items()],
    )
    return conform(scope.only_day(picked, day), LOAN_RISK)


def from_statement(rows: DataFrame, day: str | None = None) -> DataFrame:
    """The branch inside the row counts only where the header's is NULL (not where it is empty)."""
    return _rows(rows, "ACCT_NO", STATEMENT, day, {
        "CUSTOMER_NO": cleanse.customer_id("CUST_NO"), "CUSTOMER_NAME": cleanse.trimmed("NAME"),
        "PRODUCT_DESCRIPTION": cleanse.trimmed("PROD_DESCRIPTION"), "SYSTEM_CODE": cleanse.trimmed("SYS"),
        "NPA_CLASSIFICATION": cleanse.asset_class("NI"), "OLD_IRAC": cleanse.trimmed("OI"), "NEW_IRAC": cleanse.trimmed("NI"),
        "NPA_DATE": cleanse.date("NPA_DATE"), "LAST_ARREARS_DATE": cleanse.date("LST_ARR_D"),
        "BALANCE_OUTSTANDING": cleanse.amount("BAL_OUTSTAND"), "OVERDUE_INTEREST": cleanse.amount("OVERDUE_INT"),
        "INCA": cleanse.amount("INCA"), "UIPY": cleanse.amount("UIPY"), "IRREGULAR_AMOUNT": cleanse.amount("IRR_AMT"),
    }, branch="coalesce(BRANCH_CODE, BR_NO)", confirmed=True)


def from_npa_list(rows: DataFrame, day: str | None = None) -> DataFrame:
    return _rows(rows, "ACCOUNT_NUMBER", NPA_LIST, day, {
        "CUSTOMER_NAME": cleanse.trimmed("CUSTOMER_NAME"), "NPA_CLASSIFICATION": cleanse.asset_class("NEW_IRAC"),
        "OLD_IRAC": cleanse.trimmed("OLD_IRAC"), "NEW_IRAC": cleanse.trimmed("NEW_IRAC"), "NPA_DATE": cleanse.date("NPA_DATE"),
        "BALANCE_OUTSTANDING": cleanse.amount("OUTSTANDING"), "OUTSTANDING": cleanse.amount("OUTSTANDING"),
        "INCA": cleanse.amount("INCA"), "UIPY": cleanse.amount("UIPY"), "ARREAR_CONDITION": cleanse.trimmed("ARR_COND"),
    }, confirmed=True)


def from_probable(rows: DataFrame, day: str | None = None) -> DataFrame:
    return _rows(rows, "ACCOUNT_NO", PROBABLE, day, {
        "CUSTOMER_NAME": cleanse.trimmed("ACCOUNT_NAME"), "PRODUCT_DESCRIPTION": cleanse.trimmed("FACILITY"),
        "OUTSTANDING": cleanse.amount("OUTSTANDING"), "LIMIT_AMOUNT": cleanse.amount("LIMIT"),
        "RISK_GRADE": cleanse.trimmed("RISK_GRADE"),
    }, probable=True)


def from_arrears(rows: DataFrame, day: str | None = None) -> DataFrame:
    return _rows(rows, "LOAN_ACCOUNT", ARREARS, day, {
        "PRODUCT_DESCRIPTION": cleanse.trimmed("PRODUCT_DESCRIPTION"), "BALANCE_OUTSTANDING": cleanse.amount("ACCOUNT_BALANCE"),
        **{s: cleanse.amount(s) for s in SLABS},
        "ARREARS_3Y_PLUS": labels.null_safe_sum(*[cleanse.amount(s) for s in LONG_SLABS]),
    })


def from_irregular(rows: DataFrame, day: str | None = None) -> DataFrame:
    return _rows(rows, "ACCOUNT_NO", IRREGULAR, day, {
        "CUSTOMER_NAME": cleanse.trimmed("NAME_OF_BORROWER"), "PRODUCT_DESCRIPTION": cleanse.trimmed("DESCRIPT"),
        "OUTSTANDING": cleanse.amount("OUTSTANDING"), "IRREGULAR_AMOUNT": cleanse.amount("IRREGULARITY"),
        "OLD_IRAC": cleanse.asset_class("OLD_BAD_IND"), "NEW_IRAC": cleanse.asset_class("NEW_BAD_IND"),
    })


def from_excess_draw(rows: DataFrame, day: str | None = None) -> DataFrame:
    return _rows(rows, "ACCOUNT_NUMBER", EXCESS, day, {
        "CUSTOMER_NAME": cleanse.trimmed("NAME_OF_BORROWER"), "PRODUCT_DESCRIPTION": cleanse.trimmed("PRODUCT_SUBPRODUCT_TYPE"),
        "OUTSTANDING": cleanse.amount("OUTSTANDING"), "LIMIT_AMOUNT": cleanse.amount("LIMIT_AMOUNT"),
        "DRAWING_POWER": cleanse.amount("DRAWING_POWER"), "IRREGULAR_AMOUNT": cleanse.amount("IRREGULARITY"),
    })


def from_drawing_power(rows: DataFrame, day: str | None = None) -> DataFrame:
    """Updates only; never a row of its own."""
    return _rows(rows, "ACCOUNT_NO", DRAWING, day, {
        "DRAWING_POWER": cleanse.amount("DRAWING_POWER"), "DP_VARIANCE": cleanse.amount("ACTUAL_VARIANCE"),
        "OUTSTANDING": cleanse.amount("OUTSTANDING"), "BENCHMARK_LEVEL": cleanse.trimmed("BENCHMARK_LEVEL"),
        "TOLERANCE_LEVEL": cleanse.trimmed("TOLERANCE_LEVEL"),
    })


BUILDERS = {
    STATEMENT: from_statement, NPA_LIST: from_npa_list, PROBABLE: from_probable, ARREARS: from_arrears,
    IRREGULAR: from_irregular, EXCESS: from_excess_draw, DRAWING: from_drawing_power,
}


def candidate_rows(staged: dict[str, DataFrame], day: str | None = None) -> DataFrame:
    """All keyed rows of the reports that are there, with their place in the order."""
    out = None
    for table, build in BUILDERS.items():
        if table in staged:
            rows = build(staged[table], day).withColumn("_place", F.lit(PLACE[table]))
            out = rows if out is None else out.unionByName(rows)
    return out


def _of(table: str) -> Column:
    return F.col("_place") == PLACE[table]


def foremost(rows: DataFrame, with_copies: bool = False) -> DataFrame:
    """Per (date, account) the foremost report's row with its ``_place``, ``slabs`` and ``power``: the arrears and
    drawing-power values. Of several rows of one report the smallest by value stands for all, of several updates the greatest;
    ``copies`` counts the rows of the chosen report. One grouping finds all four, so the reports are read and cleaned once; rows
    of one key meet before the shuffle too, so a busy key costs nothing."""
    fields = [c for c in LOAN_RISK if c not in KEYS]
    own = F.col("_place") < PLACE[DRAWING]
    # Accounts first: they tell rows apart where a sort looks first.
    best = rows.groupBy(*reversed(KEYS)).agg(
        F.min(F.when(own, F.struct("_place", *fields))).alias("_best"),
        F.max(F.when(_of(ARREARS), F.struct(*SLABS, "ARREARS_3Y_PLUS"))).alias("slabs"),
        F.max(F.when(_of(DRAWING), F.struct(*DRAWING_VALUES))).alias("power"),
        *([F.count_if(_of(t)).alias(f"_n{PLACE[t]}") for t in PRECEDENCE] if with_copies else []),
    ).filter("_best is not null")
    copies = [F.element_at(F.array(*[f"_n{PLACE[t]}" for t in PRECEDENCE]), F.col("_best._place") + 1).alias("copies")] if with_copies else []
    return best.select(*KEYS, "_best.*", "slabs", "power", *copies)


def loan_risk(staged: dict[str, DataFrame], day: str | None = None, with_copies: bool = False) -> DataFrame:
    """The fact rows; ``with_copies`` adds how often the chosen report lists the account."""
    complete, _ = quality.split_missing(candidate_rows(staged, day), KEYS)
    best = foremost(complete, with_copies)
    place = F.col("_place")
    has_slabs = F.col("slabs").isNotNull() & (place < PLACE[ARREARS])
    has_power = F.col("power").isNotNull() & (place <= PLACE[ARREARS])

    def value(c: str) -> Column:
        if c in KEYS:
            return F.col(c)
        own = F.col(c)
        if c in (*SLABS, "ARREARS_3Y_PLUS"):
            return F.when(has_slabs, F.col(f"slabs.{c}")).otherwise(own)
        if c == "OUTSTANDING":
            return F.when(has_power, F.coalesce(own, F.col("power.OUTSTANDING"))).otherwise(own)
        if c in DRAWING_VALUES:
            return F.when(has_power, F.col(f"power.{c}")).otherwise(own)
        return own

    columns = [value(c).alias(c) for c in LOAN_RISK]
    return best.select(*columns, "copies") if with_copies else best.select(*columns)
