"""General-ledger product summary: class totals, account balances and daily product flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleanse
from ..operators import joining, lineage, scope
from .schemas import GL_SUMMARY, conform

TOTALS, BALANCES = "GLCC_WISE_SUM_REP", "GLCC_WISE_BAL_REP"
FLOWS = "DAILY_PRODUCTWISE_REPORT_LOAN_DEP_CLEARING_GNBD7376"
KEYS = ["SNAPSHOT_DATE", "BRANCH_CODE", "GL_CLASS_CODE"]

# Flow columns of the report and of the summary.
FLOW_COLUMNS = {
    "CASH_CREDIT": "DAILY_CASH_CREDIT", "CASH_DEBIT": "DAILY_CASH_DEBIT", "CLEARING_CREDIT": "DAILY_CLR_CREDIT",
    "CLEARING_DEBIT": "DAILY_CLR_DEBIT", "TRANSFER_CREDIT": "DAILY_TFR_CREDIT", "TRANSFER_DEBIT": "DAILY_TFR_DEBIT",
    "PRODUCT_TOTAL_CREDIT": "DAILY_TOTAL_CREDIT", "PRODUCT_TOTAL_DEBIT": "DAILY_TOTAL_DEBIT",
}


def _keyed(rows: DataFrame, code: str, must_have: str, day: str | None) -> DataFrame:
    keyed = rows.filter(scope.key_present(must_have)).withColumns({
        "_day": cleanse.date("PROC_DATE"), "_branch": cleanse.branch_code("BRANCH_CODE"), "_code": cleanse.trimmed(code)})
    return scope.only_day(keyed, day, "_day")


def _grouped(rows: DataFrame, name: Column | None = None, **totals: Column) -> DataFrame:
    """Totals per key, with the greatest name and the smallest report. Spark sorts all rows for the least or greatest text of a
    group but adds up figures in a hash table; so the texts are keys at first, and only the few sums per text are sorted."""
    texts = [] if name is None else [name.alias("PRODUCT_NAME")]
    by_text = rows.groupBy(
        F.col("_day").alias("SNAPSHOT_DATE"), F.col("_branch").alias("BRANCH_CODE"), F.col("_code").alias("GL_CLASS_CODE"), *texts, "REPORT_ID"
    ).agg(*[c.alias(n) for n, c in totals.items()])
    return by_text.groupBy(*KEYS).agg(
        *[F.sum(n).alias(n) for n in totals], *[F.max("PRODUCT_NAME").alias("PRODUCT_NAME") for _ in texts], F.min("REPORT_ID").alias("SOURCE_REPORT_ID"))


def _sum(name: str):
    return F.sum(cleanse.amount(name))


def class_totals(rows: DataFrame, day: str | None = None) -> DataFrame:
    out = _grouped(
        _keyed(rows, "GL_CLASS_CODE", "GL_CLASS_CODE", day), cleanse.trimmed("NAME"),
        ACCOUNT_COUNT=F.sum(cleanse.whole_number("ACT_TOTAL")), TOTAL_DR_BALANCE=_sum("TOTAL_AMOUNT"),
        TOTAL_INTEREST=_sum("TOTAL_INTEREST"), TOTAL_DR_OD_INT=_sum("TOTAL_DR_OD_INT"),
        TOTAL_UNCLEARED=_sum("TOTAL_UNCLEARED_AMT"), TOTAL_COLLECTION=_sum("TOTAL_COLLECTION_AMT"))
    return conform(out.withColumn("SOURCE_TABLE", F.lit(TOTALS)), GL_SUMMARY)


def account_totals(rows: DataFrame, day: str | None = None) -> DataFrame:
    out = _grouped(
        _keyed(rows, "GL_CLASS_CODE", "GL_CLASS_CODE", day), ACCOUNT_COUNT=F.count("*"), TOTAL_DR_BALANCE=_sum("DR_BALANCE"),
        TOTAL_CR_BALANCE=_sum("CR_BALANCE"), TOTAL_INTEREST=_sum("INT_BALANCE"), TOTAL_DR_OD_INT=_sum("OD_DR_INT_BAL"),
        TOTAL_UNCLEARED=_sum("UNCLRED_BAL"), TOTAL_COLLECTION=_sum("COLL_AMT"))
    return conform(out.withColumn("SOURCE_TABLE", F.lit(BALANCES)), GL_SUMMARY)


def daily_flows(rows: DataFrame, day: str | None = None) -> DataFrame:
    """Flows per (date, branch, product code), as summary rows."""
    out = _grouped(
        _keyed(rows, "PROD_CODE", "ACCOUNT_NO", day), cleanse.trimmed("PROD_DESC"),
        ACCOUNT_COUNT=F.count("*"), **{target: _sum(source) for source, target in FLOW_COLUMNS.items()})
    return conform(out.withColumn("SOURCE_TABLE", F.lit("GNBD7376")), GL_SUMMARY)


def matching_flows(summary: DataFrame, flows: DataFrame) -> DataFrame:
    """One flow row per summary key whose class contains the product code.

    The reference takes an arbitrary match; here the longest product code wins, then the smallest.
    """
    flows = flows.withColumnRenamed("GL_CLASS_CODE", "PROD_CODE")
    pairs = joining.contained_codes(summary, flows)
    values = list(FLOW_COLUMNS.values())
    candidates = summary.select(*KEYS).join(pairs, "GL_CLASS_CODE").join(
        flows.select("SNAPSHOT_DATE", "BRANCH_CODE", "PROD_CODE", *values), ["SNAPSHOT_DATE", "BRANCH_CODE", "PROD_CODE"])
    longest = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.length("PROD_CODE").desc(), "PROD_CODE"))
    return candidates.withColumn("_nth", longest).filter("_nth = 1").select(*KEYS, *values)


def gl_summary(staged: dict[str, DataFrame], day: str | None = None) -> DataFrame:
    """Totals, then balances of classes without totals, then flows: matched classes take
    them over, product codes that are no class of their own are added. The grouped reports are small and needed several
    times, each with other columns: they are settled, so that every report is read and cleaned once.
    """
    parts = []
    if TOTALS in staged:
        totals = class_totals(staged[TOTALS], day)
        parts.append(lineage.settled(totals) if BALANCES in staged else totals)
    if BALANCES in staged:
        balances = account_totals(staged[BALANCES], day)
        parts.append(balances.join(parts[0].select(*KEYS), KEYS, "left_anti") if parts else balances)
    summary = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None
    if FLOWS not in staged:
        return summary
    flows = daily_flows(staged[FLOWS], day)
    if summary is None:
        return flows
    summary, flows = lineage.settled(summary), lineage.settled(flows)
    updated = joining.update_from(
        summary, matching_flows(summary, flows), KEYS, {c: F.col(f"s.{c}") for c in FLOW_COLUMNS.values()})
    return updated.unionByName(flows.join(summary.select(*KEYS), KEYS, "left_anti"))
