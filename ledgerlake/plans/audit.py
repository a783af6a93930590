"""Audit exceptions from four reports, with their severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleanse, labels
from ..operators import scope
from .schemas import AUDIT_EXCEPTIONS, conform

BREACHES, RATES = "EXCEPTION_REPORT_DEPD0670", "EXCEPTION_REPORT_FOR_INTEREST_RATES_VARIATION_DEPD0650"
LARGE, LIENS = "REPORT_HIGH_VALUE_TRANSACTIONS", "LIEN_MARKED_REMOVAL_DEPD0702"


def _rows(rows: DataFrame, account: str, kind: str, source: str, day: str | None, columns: dict[str, Column]) -> DataFrame:
    picked = rows.filter(scope.key_present(account)).select(
        cleanse.date("PROC_DATE").alias("SNAPSHOT_DATE"), cleanse.branch_code("BRANCH_CODE").alias("BRANCH_CODE"),
        cleanse.account_no(account).alias("ACCOUNT_NO"), F.lit(kind).alias("EXCEPTION_TYPE"),
        F.col("REPORT_ID").alias("SOURCE_REPORT_ID"), F.lit(source).alias("SOURCE_TABLE"),
        *[c.alias(n) for n, c in columns.items()])
    return conform(scope.only_day(picked, day), AUDIT_EXCEPTIONS)


def limit_breaches(rows: DataFrame, day: str | None = None) -> DataFrame:
    amount = cleanse.amount("AMOUNT")
    return _rows(rows, "ACCOUNT_NO", "TXN_LIMIT_BREACH", BREACHES, day, {
        "CUSTOMER_NAME": cleanse.trimmed("CUSTOMER_NAME"), "TRAN_CODE": cleanse.trimmed("TRAN_CODE"),
        "JOURNAL_NO": cleanse.trimmed("JRNL_NO"), "AMOUNT": amount, "OUTSTANDING": cleanse.amount("OUTSTANDING"),
        "LIMIT_AMOUNT": cleanse.amount("LIMIT_AMOUNT"), "ERROR_DESC": cleanse.trimmed("ERROR_DESC"),
        "SUP_ID": cleanse.trimmed("SUP_ID"), "SUP_ERR_NO": cleanse.trimmed("SUP_ERR_NO"),
        "SEVERITY": labels.breach_severity(amount),
    })


def rate_variances(rows: DataFrame, day: str | None = None) -> DataFrame:
    product, effective = cleanse.plain_rate("PRODUCT_INT_RATE"), cleanse.plain_rate("EFFECTIVE_INT_RATE")
    gap = labels.rate_gap(effective, product)
    return _rows(rows, "ACCOUNT_NUMBER", "INT_RATE_VARIANCE", RATES, day, {
        "CUSTOMER_NAME": cleanse.trimmed("CUSTOMER_NAME"), "SANCTION_AMOUNT": cleanse.amount("SANCTION_AMOUNT"),
        "ACCOUNT_TYPE": cleanse.trimmed("ACCT_TYPE"), "SUB_TYPE": cleanse.trimmed("SUB_TYPE"), "PRODUCT_INT_RATE": product,
        "EFFECTIVE_INT_RATE": effective, "RATE_VARIANCE": gap, "SEVERITY": labels.rate_severity(gap),
    })


def large_transactions(rows: DataFrame, day: str | None = None) -> DataFrame:
    amount = cleanse.amount("AMOUNT")
    return _rows(rows, "ACCOUNT_NO", "HIGH_VALUE_TXN", LARGE, day, {
        "CUSTOMER_NAME": cleanse.trimmed("ACCOUNT_NAME"), "AMOUNT": amount, "TRANSACTION_DATE": cleanse.date("TRANS_DATE"),
        "NARRATION": cleanse.trimmed("NARRATION"), "SEVERITY": labels.large_txn_severity(amount),
    })


def lien_operations(rows: DataFrame, day: str | None = None) -> DataFrame:
    amount = cleanse.amount("LIEN_AMOUNT")
    return _rows(rows, "ACCOUNT_NO", "LIEN_OPERATION", LIENS, day, {
        "ACCOUNT_TYPE": cleanse.trimmed("TYPE_OF_ACCOUNT"), "LIEN_AMOUNT": amount, "LIEN_ACTION": labels.lien_action("MARK_REM"),
        "LIEN_REASON": cleanse.trimmed("REASON"), "USER_ID": cleanse.trimmed("USER_ID"),
        "CHECKER_ID": cleanse.trimmed("CHK_ID"), "SEVERITY": labels.lien_severity(amount),
    })


BUILDERS = {BREACHES: limit_breaches, RATES: rate_variances, LARGE: large_transactions, LIENS: lien_operations}


def audit_exceptions(staged: dict[str, DataFrame], day: str | None = None) -> DataFrame:
    out = None
    for table, build in BUILDERS.items():
        if table in staged:
            rows = build(staged[table], day)
            out = rows if out is None else out.unionByName(rows)
    return out
