"""Account facts: daily snapshot of deposits, loans and overdrafts; opened and closed accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleanse, labels
from ..operators import scope
from .schemas import ACCOUNT_SNAPSHOT, conform

DEPOSITS, LOANS, OVERDRAFTS = "DEPOSITS_BALANCE_FILE_DEPD0586", "LOANSBALANCEFILE_LOND2390", "CC_OD_BALANCE_FILE_DEPD0580"
CATEGORY_OF = {DEPOSITS: "DEPOSIT", LOANS: "LOAN", OVERDRAFTS: "CC_OD"}


def _snapshot(rows: DataFrame, key: str, source: str, day: str | None, columns: dict) -> DataFrame:
    """Keyed rows of one balance report, for one day when given."""
    picked = rows.filter(scope.key_present(key)).select(
        cleanse.date("PROC_DATE").alias("SNAPSHOT_DATE"), cleanse.account_no(key).alias("ACCOUNT_NO"),
        cleanse.trimmed("CUSTOMER_NAME").alias("CUSTOMER_NAME"), cleanse.branch_code("BRANCH_CODE").alias("BRANCH_CODE"),
        F.lit(CATEGORY_OF[source]).alias("ACCOUNT_CATEGORY"), F.col("REPORT_ID").alias("SOURCE_REPORT_ID"),
        F.lit(source).alias("SOURCE_TABLE"), *[c.alias(n) for n, c in columns.items()],
    )
    return conform(scope.only_day(picked, day), ACCOUNT_SNAPSHOT)


def deposit_accounts(rows: DataFrame, day: str | None = None) -> DataFrame:
    return _snapshot(rows, "ACCOUNT_NUMBER", DEPOSITS, day, {
        "ACCOUNT_TYPE": cleanse.trimmed("ACCOUNT_TYPE"), "CURRENT_BALANCE": cleanse.amount("CURRENT_BALANCE"),
        "AVAILABLE_BALANCE": cleanse.amount("AVAILABLE_BALANCE"), "UNCLEARED_BALANCE": cleanse.amount("UNCLEARED_BALANCE"),
        "SANCTIONED_LIMIT": cleanse.amount("LIMIT"), "INTEREST_RATE": cleanse.rate("INT_RATE"),
        "ACCOUNT_STATUS": cleanse.rate_status("INT_RATE", "STATUS"), "JOINT_HOLD_FLAG": cleanse.trimmed("JOINT_HOLD_FLAG"),
    })


def loan_accounts(rows: DataFrame, day: str | None = None) -> DataFrame:
    return _snapshot(rows, "ACCOUNT_NO", LOANS, day, {
        "ACCOUNT_TYPE": cleanse.trimmed("ACCOUNT_TYPE"), "OUTSTANDING": cleanse.amount("OUTSTANDING"),
        "SANCTIONED_LIMIT": cleanse.amount("LIMIT"), "INTEREST_RATE": cleanse.plain_rate("INT_RATE"),
        "IRREGULARITY": cleanse.amount("IRREGULARITY"), "THEORETICAL_BALANCE": cleanse.amount("THEO_BAL"),
        "SANCTION_DATE": cleanse.date("SANCTION_DATE"), "NEW_IRAC": cleanse.trimmed("NEW_IRAC"),
        "OLD_IRAC": cleanse.trimmed("OLD_IRAC"), "EMI_DUE": cleanse.whole_number("EMIS_DUE"),
        "EMI_PAID": cleanse.whole_number("EMIS_PAID"), "EMI_OVERDUE": cleanse.whole_number("EMIS_OVERDUE"),
        "ADVANCE_PAID_AMT": cleanse.amount("ADV_PAID_AMT"), "ARREAR_CONDITION": cleanse.trimmed("ARREAR_COND"),
        "ACCT_MAINTAIN_BRANCH": cleanse.branch_code("ACCT_MTAIN_BRCH"),
    })


def overdraft_accounts(rows: DataFrame, day: str | None = None) -> DataFrame:
    return _snapshot(rows, "ACCOUNT_NUM", OVERDRAFTS, day, {
        "ACCOUNT_TYPE": cleanse.trimmed("ACCOUNT_TYP_DESC"), "CURRENT_BALANCE": cleanse.amount("ACCOUNT_BALANCE"),
        "UNCLEARED_BALANCE": cleanse.amount("UNCLEARED_BALANCE"), "SANCTIONED_LIMIT": cleanse.amount("LIMIT"),
        "DRAWING_POWER": cleanse.amount("DRAWING_POWER"), "IRREGULARITY": cleanse.amount("IRREGULARITY"),
        "INTEREST_RATE": cleanse.plain_rate("RATE"), "ACCOUNT_STATUS": cleanse.account_status("STATUS"),
        "ARREAR_CONDITION": cleanse.trimmed("ARREAR_COND"), "LIMIT_EXPIRY_DATE": cleanse.date("LMT_EXPY_DT"),
        "SANCTION_DATE": cleanse.date("SANCTION_DT"), "ACCT_MAINTAIN_BRANCH": cleanse.branch_code("ACCT_MAINTAIN_BRANCH"),
    })


BUILDERS = {DEPOSITS: deposit_accounts, LOANS: loan_accounts, OVERDRAFTS: overdraft_accounts}


def account_snapshot(staged: dict[str, DataFrame], day: str | None = None) -> DataFrame:
    """All account kinds whose report is there."""
    out = None
    for table, build in BUILDERS.items():
        if table in staged:
            rows = build(staged[table], day)
            out = rows if out is None else out.unionByName(rows)
    return out


def _movement(rows: DataFrame, date_column: str) -> list:
    return [
        cleanse.date(date_column).alias(date_column), cleanse.account_no("ACCOUNT_NUMBER").alias("ACCOUNT_NO"),
        cleanse.trimmed("ACCOUNT_NAME").alias("CUSTOMER_NAME"), cleanse.branch_code("BRANCH_CODE").alias("BRANCH_CODE"),
        labels.product_category("PRODUCT").alias("ACCOUNT_CATEGORY"), cleanse.trimmed("PRODUCT").alias("PRODUCT_CODE"),
    ]


def opened_accounts(rows: DataFrame) -> DataFrame:
    """The balance must be a number (blank is 0): bad text fails the load."""
    balance = F.coalesce(F.nullif(F.replace("BALANCE", F.lit(","), F.lit("")), F.lit("")), F.lit("0"))
    return rows.select(*_movement(rows, "OPENED_DATE"), balance.cast("decimal(18,2)").alias("BALANCE"))


def closed_accounts(rows: DataFrame) -> DataFrame:
    return rows.select(*_movement(rows, "CLOSED_DATE"))
