"""Which layout reads a file: by report id, file name, or line length of shadow files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .files import file_name

# Report ids and file-name keys with the table their layout fills.
ROUTES = {
    "ACTCLS-01": "ACCOUNT_CLOSED_REPORT",
    "ACTOPN-01": "ACCOUNT_OPENED_REPORT",
    "AU0035-01": "ACCOUNT_ALTERATION",
    "BR2572-01": "LISTOF_NPA_ACCOUNTS_LOND2572",
    "GL7046-01": "BAL_IN_GL_ACC_GLCC_WISE_DET",
    "GL7044-01": "BAL_IN_LOAN_ACC_GLCC_WISE_DET",
    "GL7044-02": "BAL_IN_LOAN_ACC_GLCC_WISE_SUM",
    "BR2498-01": "ARREARS_BREAK_UP_LOND2498",
    "GL0600-01": "BGL_TXN_ENQUIRY_GEND0600",
    "IN0580-01": "CC_OD_BALANCE_FILE_DEPD0580",
    "BR2444-01": "COLL_MATURED_SEC_LOND2444",
    "GL0807-01": "GL_DAYBOOK_GEND0807",
    "SY0300-01": "HOMEBRANCHUSERS_CFPD0300",
    "BR2482-01": "ID_LEAST_TRANSACTION_LOND2482",
    "GL7042-01": "CREDIT_BALANCE_IN_EXPENSE_ACCOUNT_GEND7042",
    "customer_member": "CUSTOMER_MEMBER_REPORT",
    "GB7376": "DAILY_PRODUCTWISE_REPORT_LOAN_DEP_CLEARING_GNBD7376",
    "GL7041-01": "DEBIT_BALANCE_IN_INCOME_ACCOUNT_GEND7041",
    "GL7045-01": "DEBIT_TRANSACTIONS_ON_INCOME_ACCT_GEND7045",
    "IN0586-01": "DEPOSITS_BALANCE_FILE_DEPD0586",
    "BR2388-01": "DRAWING_POWER_LOND2388",
    "IN0670-01": "EXCEPTION_REPORT_DEPD0670",
    "IN0650-01": "EXCEPTION_REPORT_FOR_INTEREST_RATES_VARIATION_DEPD0650",
    "GL1012-01": "GEND1012_PRT",
    "GL1012-02": "GEND1012_PRT2",
    "shadow_file": "DEP_SHADOW_FILE",
    "dep_shadow": "DEP_SHADOW_FILE",
    "loan_shadow_file": "LOAN_SHADOW_FILE",
    "loan_shadow": "LOAN_SHADOW_FILE",
    "GL7043-01": "GLCC_WISE_BAL_REP",
    "GL7043-02": "GLCC_WISE_SUM_REP",
    "gend7041": "DEBIT_BALANCE_IN_INCOME_ACCOUNT_GEND7041",
    "gend7045": "DEBIT_TRANSACTIONS_ON_INCOME_ACCT_GEND7045",
    "NPAD0001": "NPA_STMT",
    "SY0337-01": "INTERESTRATECHANGELOANS_CFPD0337",
    "BR2397-01": "IRREGULAR_EXCESS_DRAW_LOND2397CPC",
    "NPALIST1": "LIST_OF_NPA_ACCOUNTS",
    "BR2390-01": "LOANSBALANCEFILE_LOND2390",
    "BR2490-01": "LOAN_IRREGULAR_REPORT",
    "SY0363-01": "NON_HOME_BRANCH_CIFD0363",
    "BR2463-01": "PROBABLE_NPA_REPORT_LOND2463",
    "BR2599-01": "REPORT_HIGH_VALUE_TRANSACTIONS",
    "BR2443-01": "REPORT_MATURING_SECURITIES_LOND2443",
    "SY0388-01": "RUPEE_DRAWING_LIST_CFPD0388",
    "GN7484": "SUPPLIMENTARY_REPORT_GEND7484",
    "GN7484_2": "SUPPLIMENTARY_REPORT_GEND7484",
    "GN7516": "SUPPLIMENTARY_CONTROL_GEND7516",
    "GN7516_2": "TRANSFER_SUPPLEMENTARY_GEND7516",
    "SY0331-01": "VOUCHER_VARIFICATION_REPORT_CFPD0331",
    "SY0344-01": "VOUCHER_VARIFICATION_REPORT_CFPD0344",
    "CIFD0528": "INTERBRANCH_TRANSACTIONS_CIFD0528",
    "BR2482-02": "ID_USERS_LOGGED_NO_TRANSACTIONS_LOND2482",
    "BR2482-03": "ID_USERS_TERMINALS_NOT_LOGGED_LOND2482",
    "GL7053-01": "AGEWISE_REPORT_OF_SYS_SUSP_GEND7053",
    "ADVICEFORTD": "ADVICEFORTD",
    "LOANS_SANCTION_LETTER": "LOANS_SANCTION_LETTER",
    "IN0623-01": "MATURITY_LIST_DEPD0623",
    "OVERDUE_NOTICE": "OVERDUE_NOTICE_LOND2384",
    "VP7634": "INVENTORY_REPORT",
    "DEPD637T": "INT_PAID_PROJ",
    "CA0198-01": "CHEQUE_BOOK_ISSUE_ORDER_CASD0198",
    "BR2543-01": "SYSTEM_GENERATED_TRANSACTIONS_LOND2543",
    "IN0762-01": "DAILY_BRANCH_OPEND_ACCOUNTS_NONWKIT",
    "nonwkit": "DAILY_BRANCH_OPEND_ACCOUNTS_NONWKIT",
    "GL0805-01": "AUDIT_BGL_ACCOUNTS_AGE_WISE_BREAK_UP_GEND0805",
    "IN0702-01": "LIEN_MARKED_REMOVAL_DEPD0702",
    "GL0808-01": "GL_OUTSTANDING_ACCNTS_GENM0808",
    "SY0305-01": "DETAILS_OF_INVENTORY_RECD_CFPD0305",
    "depd0903": "SYSTEM_TRANSACTIONS_REPORT_DEPD0903",
    "IN0903": "SYSTEM_TRANSACTIONS_REPORT_DEPD0903",
}
SHADOW_MIN_TEXT, DEPOSIT_SHADOW_LENGTH, LOAN_SHADOW_LENGTH = 200, 700, 500


def _refined(report_id: Column, name: Column) -> Column:
    """Ids shared by several reports are told apart by the file name."""
    transfer = name.contains("transfer_supplementary")
    return (
        F.when((report_id == "GN7484") & transfer, "GN7484_3")
        .when((report_id == "GN7484") & name.contains("supplimentary_report"), "GN7484_2")
        .when((report_id == "GN7516") & transfer, "GN7516_2")
        .otherwise(report_id)
    )


def _key_in_name(name: Column) -> Column:
    """Longest key contained in the file name."""
    key = F.lit(None).cast("string")
    for candidate in sorted(ROUTES, key=len):
        key = F.when(name.contains(candidate.lower()), candidate).otherwise(key)
    return key


def _table_of(key: Column) -> Column:
    table = F.lit(None).cast("string")
    for value, name in ROUTES.items():
        table = F.when(key == value, name).otherwise(table)
    return table


def shadow_lengths(lines: DataFrame) -> DataFrame:
    """(path, shadow_length): length of the first long line of each shadow file."""
    long = (F.length(strip(F.col("line"))) > SHADOW_MIN_TEXT) & F.lower(file_name(F.col("path"))).contains("shadow")
    return lines.filter(long).groupBy("path").agg(F.min_by(F.length("line"), "line_no").alias("shadow_length"))


def route(files: DataFrame) -> DataFrame:
    """Adds ``route_key`` and ``layout`` (NULL when no layout fits).

    ``files``: path, REPORT_ID and, when known, shadow_length. The key list is fixed, so it is
    one expression over the row rather than a join.
    """
    name = F.lower(file_name(F.col("path")))
    asked = _refined(F.col("REPORT_ID"), name)
    length = F.col("shadow_length") if "shadow_length" in files.columns else F.lit(None).cast("int")
    by_shape = F.when(
        name.contains("shadow"),
        F.when(length >= DEPOSIT_SHADOW_LENGTH, "shadow_file").when(length >= LOAN_SHADOW_LENGTH, "loan_shadow_file"),
    )
    known = F.when(asked.isin(*ROUTES), asked)
    return (
        files.withColumn("route_key", F.coalesce(known, by_shape, _key_in_name(name)))
        .withColumn("layout", _table_of(F.col("route_key")))
    )


def coverage(routed: DataFrame, existing_tables: list[str]) -> DataFrame:
    """(layout, coverage, files): files per target table, split into existing, new and unsupported."""
    kind = (
        F.when(F.col("layout").isNull(), "unsupported")
        .when(F.upper("layout").isin(*[t.upper() for t in existing_tables]) if existing_tables else F.lit(False), "existing")
        .otherwise("new")
    )
    return routed.groupBy("layout", kind.alias("coverage")).agg(F.count("*").alias("files"))
