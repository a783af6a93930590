"""Warehouse table schemas (fixed values: column names and types of the star schema)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY, RATE = "decimal(18,2)", "decimal(8,4)"


def _columns(text: str) -> dict[str, str]:
    kinds = {"m": MONEY, "r": RATE, "s": "string", "d": "date", "i": "int", "b": "boolean"}
    return {name: kinds[kind] for name, kind in (entry.split(":") for entry in text.split())}


ACCOUNT_SNAPSHOT = _columns(
    "SNAPSHOT_DATE:d ACCOUNT_NO:s CUSTOMER_NO:s CUSTOMER_NAME:s BRANCH_CODE:s ACCOUNT_CATEGORY:s ACCOUNT_TYPE:s "
    "PRODUCT_DESCRIPTION:s CURRENT_BALANCE:m AVAILABLE_BALANCE:m UNCLEARED_BALANCE:m SANCTIONED_LIMIT:m DRAWING_POWER:m "
    "OUTSTANDING:m IRREGULARITY:m THEORETICAL_BALANCE:m INTEREST_RATE:r TERM_MONTHS:i ACCOUNT_STATUS:s ARREAR_CONDITION:s "
    "SANCTION_DATE:d OPEN_DATE:d CLOSE_DATE:d MATURITY_DATE:d LIMIT_EXPIRY_DATE:d NEW_IRAC:s OLD_IRAC:s EMI_DUE:i EMI_PAID:i "
    "EMI_OVERDUE:i ADVANCE_PAID_AMT:m JOINT_HOLD_FLAG:s ACCT_MAINTAIN_BRANCH:s SOURCE_REPORT_ID:s SOURCE_TABLE:s"
)
LOAN_RISK = _columns(
    "SNAPSHOT_DATE:d ACCOUNT_NO:s CUSTOMER_NO:s CUSTOMER_NAME:s BRANCH_CODE:s PRODUCT_DESCRIPTION:s SYSTEM_CODE:s "
    "NPA_CLASSIFICATION:s OLD_IRAC:s NEW_IRAC:s NPA_DATE:d LAST_ARREARS_DATE:d BALANCE_OUTSTANDING:m OVERDUE_INTEREST:m "
    "INCA:m UIPY:m IRREGULAR_AMOUNT:m ARREARS_1D_28D:m ARREARS_29D_3M:m ARREARS_3M_6M:m ARREARS_6M_1Y:m ARREARS_1Y_3Y:m "
    "ARREARS_3Y_PLUS:m DRAWING_POWER:m DP_VARIANCE:m BENCHMARK_LEVEL:s TOLERANCE_LEVEL:s OUTSTANDING:m LIMIT_AMOUNT:m "
    "RISK_GRADE:s ARREAR_CONDITION:s IS_PROBABLE_NPA:b IS_CONFIRMED_NPA:b SOURCE_REPORT_ID:s SOURCE_TABLE:s"
)
GL_SUMMARY = _columns(
    "SNAPSHOT_DATE:d BRANCH_CODE:s GL_CLASS_CODE:s PRODUCT_NAME:s ACCOUNT_COUNT:i TOTAL_DR_BALANCE:m TOTAL_CR_BALANCE:m "
    "TOTAL_INTEREST:m TOTAL_DR_OD_INT:m TOTAL_UNCLEARED:m TOTAL_COLLECTION:m DAILY_CASH_CREDIT:m DAILY_CASH_DEBIT:m "
    "DAILY_CLR_CREDIT:m DAILY_CLR_DEBIT:m DAILY_TFR_CREDIT:m DAILY_TFR_DEBIT:m DAILY_TOTAL_CREDIT:m DAILY_TOTAL_DEBIT:m "
    "SOURCE_REPORT_ID:s SOURCE_TABLE:s"
)
AUDIT_EXCEPTIONS = _columns(
    "SNAPSHOT_DATE:d BRANCH_CODE:s ACCOUNT_NO:s CUSTOMER_NAME:s EXCEPTION_TYPE:s TRAN_CODE:s JOURNAL_NO:s AMOUNT:m "
    "OUTSTANDING:m LIMIT_AMOUNT:m SANCTION_AMOUNT:m ACCOUNT_TYPE:s SUB_TYPE:s PRODUCT_INT_RATE:r EFFECTIVE_INT_RATE:r "
    "RATE_VARIANCE:r LIEN_AMOUNT:m LIEN_ACTION:s LIEN_REASON:s USER_ID:s CHECKER_ID:s TRANSACTION_DATE:d NARRATION:s "
    "ERROR_DESC:s SUP_ID:s SUP_ERR_NO:s SEVERITY:s SOURCE_REPORT_ID:s SOURCE_TABLE:s"
)
BRANCH_HIERARCHY = _columns(
    "BRANCH_CODE:s BRANCH_NAME:s REGIONAL_OFFICE_CODE:s REGIONAL_OFFICE_NAME:s HEAD_OFFICE_CODE:s DISTRICT:s ADDRESS:s IS_ACTIVE:b"
)


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """All columns of the table, in order; those a source does not carry are NULL."""
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in schema.items()])
