"""The layout catalogue: how each report is cut into columns.

Column names, positions, patterns and header words below are fixed values of the source
reports. Each entry is a function from lines to rows; ``LAYOUTS`` maps tables to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut, digits_only, has_any, made_of, part, strip
from ..operators import ordered
from . import inferred
from .extract import (
    after, bare_text, between, body, carried, fixed_width, gaps, last_piece, letter, matched, padded, piped,
    printable, raw_line, row_pattern, sliced, spans, without_titles,
)
from .lines import without_boilerplate

# ---------------------------------------------------------------- balances

_DEPD0586 = spans(
    "ACCOUNT_NUMBER:0-25 ACCOUNT_TYPE:25-55 CUSTOMER_NAME:55-122 AVAILABLE_BALANCE:122-143 "
    "UNCLEARED_BALANCE:143-165 CURRENT_BALANCE:165-188 LIMIT:188-210 TERM:210-223 INT_RATE:223-227 "
    "STATUS:227-265 JOINT_HOLD_FLAG:265-"
)


def deposits_balance(lines: DataFrame) -> DataFrame:
    rows = body(lines, "-_", 2).withColumn("_tail", F.split(cut(raw_line(), 229, 265), r"\s+"))
    rows = sliced(rows, _DEPD0586, keep=["_tail"])
    # Rate and status share the end of the line: "8.00 OPEN", a lone rate or a lone status code.
    count = F.when(part(F.col("_tail"), 0) == "", 0).otherwise(F.size("_tail"))
    first, last = part(F.col("_tail"), 0), part(F.col("_tail"), -1)
    code = first.rlike("^[0-9]{2}$")
    rows = rows.withColumns({
        "INT_RATE": F.when(count >= 2, first).when((count == 1) & ~code, first).otherwise(F.col("INT_RATE")),
        "STATUS": F.when(count >= 2, last).when((count == 1) & code, first).otherwise(F.col("STATUS")),
    }).drop("_tail")
    rows = without_titles(rows, "ACCOUNT_NUMBER", ("TOTAL", "ACCOUNT"))
    return rows.filter(~F.col("ACCOUNT_NUMBER").startswith("^"))


_LOAN_TAIL = (
    r"\s+([-0-9,]+\.\d{2})\s+([-0-9,]+\.\d{3}|[-0-9,]+\.\d+)\s+([-0-9,]+\.\d{2})\s+([-0-9,]+\.\d{2})\s+"
    r"([-0-9,]+\.\d{2})\s+(\d{2}-\d{2}-\d{4})\s+(\d+)\s+(\d+)\s+(\d+)\s+(\w+)\s+(\w+)\s+([-0-9,]+\.\d{2})\s+"
    r"(\w+)(?:\s+([A-Za-z]+))?\s+(\w+)"
)
_LOAN_TAIL_FIELDS = (
    "LIMIT INT_RATE THEO_BAL OUTSTANDING IRREGULARITY SANCTION_DATE EMIS_DUE EMIS_PAID EMIS_OVERDUE "
    "NEW_IRAC OLD_IRAC ADV_PAID_AMT ARREAR_COND CURRENCY ACCT_MTAIN_BRCH"
).split()


def loans_balance(lines: DataFrame) -> DataFrame:
    rows = body(lines, "-=", 1, skip_upper=["REPORT ID", "BRANCH CODE", "PAGE NO", "DATE", "TOTAL"])
    rows = rows.filter(bare_text().rlike(r"^\d{10,16}\s+"))
    rest = F.regexp_extract(bare_text(), r"^\d{10,16}\s+(.*)$", 1)
    rows = rows.select(
        "path", "line_no", F.regexp_extract(bare_text(), r"^(\d{10,16})", 1).alias("ACCOUNT_NO"), strip(rest).alias("_rest")
    )
    full = F.col("_rest").rlike(_LOAN_TAIL)
    head = strip(F.regexp_extract("_rest", "^(.*?)" + _LOAN_TAIL, 1))
    halves = F.split(head, r"\s{2,}", 2)
    name = F.when(F.size(halves) >= 2, F.regexp_replace(part(halves, 1), r"\s{2,}", " ")).otherwise(head)
    return rows.select(
        "path", "line_no", "ACCOUNT_NO",
        F.when(full, part(halves, 0)).otherwise("").alias("ACCOUNT_TYPE"),
        F.when(full, name).otherwise("").alias("CUSTOMER_NAME"),
        *[F.regexp_extract("_rest", _LOAN_TAIL, i).alias(n) for i, n in enumerate(_LOAN_TAIL_FIELDS, 1)],
    )


_CC_OD = (
    "ACCOUNT_NUM ACCOUNT_TYP_DESC CUSTOMER_NAME RATE LIMIT DRAWING_POWER LMT_EXPY_DT ACCOUNT_BALANCE "
    "UNCLEARED_BALANCE IRREGULARITY NEW OLD SANCTION_DT ARREAR_COND ACCT_MAINTAIN_BRANCH STATUS"
).split()


def cc_od_balance(lines: DataFrame) -> DataFrame:
    rows = body(lines, rules="-_= <>|", skip_upper=["ACCOUNT NO", "TOTAL", "NIL REPORT", "CUSTOMER"])
    return piped(rows.filter(bare_text().startswith("|")), _CC_OD, first=1, at_least=17)


# ---------------------------------------------------------------- non-performing and irregular loans

npa_statement = row_pattern(
    r"^\s*(\d+)\s+(\d+)\s+(\w+)\s+(\d+)\s+(\d+)\s+(.+?)\s+([-\d\.]+)\s+([-\d\.]+)\s+([-\d\.]+)\s+([-\d\.]+)\s+"
    r"([-\d\.]+)\s+(\d{2}-[A-Z]{3}-\d{2})\s+(\d{2}-[A-Z]{3}-\d{2})\s+(\d+)\s+(\d+)\s+(.+)$",
    "SR_NO BR_NO SYS ACCT_NO CUST_NO PROD_DESCRIPTION BAL_OUTSTAND OVERDUE_INT INCA UIPY IRR_AMT LST_ARR_D "
    "NPA_DATE NI OI NAME",
    rules="-=", skip_upper=["REPORT ID", "BRANCH CODE", "PAGE NO", "DATE", "TOTAL", "SR_NO"],
)

_LOND2572 = (
    r"^\s*(\d+)\s+(\d+)\s+(.*?)\s+([\d,]+\.\d+)\s+([\d,]+\.\d+)\s+(\d+)\s+(\d+)\s+(\d{2}-\d{2}-\d{4})\s+"
    r"([\d,]+\.\d+-?)\s+(\d+)\s+([A-Z/]+)\s+([\d,]+\.\d+)\s+(\d+)"
)
_LOND2572_BRANCH = r"^BRANCH-NO:-\s*(\d+)\s+BRANCH-NAME:-\s*(.+?)(?:\s+PAGE-NO|$)"


def npa_accounts(lines: DataFrame) -> DataFrame:
    rows = body(lines, rules="-=<>| ", boilerplate=True, skip_upper=[
        "REPORT ID", "AREA:", "RUN DATE", "PROC DATE", "PAGE NO", "SR-NO", "IRAC IRAC", "LIST OF NPA ACCOUNTS",
        "** END", "GRAND TOTAL", "PAGE-NO:",
    ]).filter(~bare_text().rlike(r"^[\x1b\x0c]"))
    upper = F.upper(bare_text())
    header = upper.rlike(_LOND2572_BRANCH)
    rows = carried(rows, {
        "BRANCH_CODE": F.when(header, padded(F.regexp_extract(upper, _LOND2572_BRANCH, 1))),
        "BRANCH_NAME": F.when(header, strip(F.regexp_extract(upper, _LOND2572_BRANCH, 2))),
    }).filter(~header)
    names = "SR_NO ACCOUNT_NUMBER CUSTOMER_NAME INCA UIPY OLD_IRAC NEW_IRAC NPA_DATE OUTSTANDING ARR_COND SYS1 INT_AMT PRODUCT"
    return matched(rows, _LOND2572, names.split(), ["BRANCH_CODE", "BRANCH_NAME"], raw_line()).withColumn("SYS2", F.lit(""))


_LOND2463 = spans(
    "SR_NO:0-15 ACCOUNT_NO:15-27 ACCOUNT_NAME:27-54 FACILITY:54-84 LIMIT:84-99 OUTSTANDING:99-112 "
    "RISK_GRADE:112-123 HOME_BRCH:123-137 OFFICE_PHONE:137-153 HOME_PHONE:153-168 REMARKS:168-"
)


def probable_npa(lines: DataFrame) -> DataFrame:
    rows = body(lines, "-_= <>|", 2, skip=["NIL REPORT"]).filter(printable(bare_text()) & (F.length(bare_text()) >= 10))
    return sliced(rows, _LOND2463).filter("SR_NO <> '' OR ACCOUNT_NO <> ''")


# Arrears: four lines per account, six to eight figures each.
_ARREARS = {
    1: "LOAN_ACCOUNT ACCOUNT_BALANCE ARREARS_1D_28D AC_BAL_1D_28D ARREARS_29D_3M AC_BAL_29D_3M ARREARS_3M_6M AC_BAL_3M_6M",
    2: "ARREARS_6M_1Y AC_BAL_6M_1Y ARREARS_1Y_3Y AC_BAL_1Y_3Y ARREARS_3Y_5Y AC_BAL_3Y_5Y",
    3: "ARREARS_5Y_7Y AC_BAL_5Y_7Y ARREARS_7Y_10Y AC_BAL_7Y_10Y ARREARS_10Y_15Y AC_BAL_10Y_15Y",
    4: "ARREARS_15Y_ABOVE AC_BAL_15Y_ABOVE",
}


def arrears_break_up(lines: DataFrame) -> DataFrame:
    title = "PRODUCT DESCRIPTION:"
    rows = without_boilerplate(lines)
    rows = carried(rows, {"PRODUCT_DESCRIPTION": F.when(raw_line().startswith(title), after(raw_line(), title))}, "UNKNOWN")
    rows = rows.filter(~raw_line().startswith(title)).withColumn("text", strip(raw_line()))
    rows = ordered.records(rows, bare_text().rlike(r"^[0-9]{8,}(\s|$)"))
    rows = ordered.nth_in_record(rows, 4)
    figures = F.split(bare_text(), r"\s+")
    wide = rows.groupBy("path", "record").agg(
        F.count("*").alias("_lines"),
        F.max(F.when(F.col("nth") == 1, F.col("PRODUCT_DESCRIPTION"))).alias("PRODUCT_DESCRIPTION"),
        *[F.max(F.when(F.col("nth") == n, figures)).alias(f"_l{n}") for n in _ARREARS],
    ).filter("_lines = 4")
    return wide.select(
        "path", F.col("record").alias("line_no"),
        *[part(F.col(f"_l{n}"), i).alias(name) for n, names in _ARREARS.items() for i, name in enumerate(names.split())],
        "PRODUCT_DESCRIPTION",
    )


_DP_FIRST = spans("SL_NO:0-9 COLLATERAL_NO:10-22 CUSTOMER_NAME:23-105 BENCHMARK_LEVEL:105-120 TOLERANCE_LEVEL:121-")
_DP_SECOND = spans(
    "ACTUAL_VARIANCE:0-28 ACCOUNT_NO:29-42 SYSTEM:43-55 OUTSTANDING:56-75 DRAWING_POWER:76-95 IRREGULARITY:95-110 REMARKS:111-"
)


def drawing_power(lines: DataFrame) -> DataFrame:
    opens = raw_line().rlike(r"^\d{2}")
    rows = ordered.records(body(lines, "-_", 1, skip=["SL NO.", "ACTUAL VARIANCE"]), opens)
    wide = rows.groupBy("path", "record").agg(
        F.max(F.when(opens, raw_line())).alias("_first"),
        F.max_by(raw_line(), F.when(~opens, F.col("line_no"))).alias("_last"),
    )
    second = F.coalesce(F.col("_last"), F.lit(""))
    return wide.select(
        "path", F.col("record").alias("line_no"),
        *[cut(F.col("_first"), a, b).alias(n) for n, (a, b) in _DP_FIRST.items()],
        *[cut(second, a, b).alias(n) for n, (a, b) in _DP_SECOND.items()],
    )


def loan_irregular(lines: DataFrame) -> DataFrame:
    """Staged cuts from the left: account, type and category, approval date, then figures."""
    rows = body(lines, "-=", 1, skip_upper=["REPORT ID", "BRANCH CODE", "PAGE NO", "DATE"])
    account = r"^(\d+)\s+([\d-]+)"
    rows = rows.filter((F.size(F.split(bare_text(), r"\s{2,}")) >= 5) & bare_text().rlike(account))
    rest = strip(F.regexp_extract(bare_text(), account + "(.*)$", 3))
    kind, day = r"^(.*?)\s(\d{4})\s+(\d{3,4})\s(.*)$", r"^(.*?)\s(\d{2}-\d{2}-\d{4})\s(.*)$"
    rows = rows.select("path", "line_no", F.regexp_extract(bare_text(), account, 1).alias("SR_NO"),
                       F.regexp_extract(bare_text(), account, 2).alias("ACCOUNT_NO"), rest.alias("_a"))
    rows = rows.withColumn("_b", F.when(F.col("_a").rlike(kind), strip(F.regexp_extract("_a", kind, 4))))
    dated = F.col("_b").rlike(day)
    rows = rows.withColumn("_c", F.when(dated, F.split(strip(F.regexp_extract("_b", day, 3)), r"\s{2,}")))
    figures = F.coalesce(F.col("_c"), F.array().cast("array<string>"))
    more = F.split(strip(F.array_join(F.slice(figures, 5, F.greatest(F.size(figures) - 4, F.lit(0))), " ")), r"\s+")
    first = "OUTSTANDING THEO_BAL IRREGULARITY INTEREST".split()
    last = "INSTALMENT EMI_NONEMI OLD_BAD_IND NEW_BAD_IND DATE".split()
    return rows.select(
        "path", "line_no", "SR_NO", "ACCOUNT_NO",
        strip(F.regexp_extract("_a", kind, 1)).alias("NAME_OF_BORROWER"),
        F.regexp_extract("_a", kind, 2).alias("TYPE"), F.regexp_extract("_a", kind, 3).alias("CAT"),
        F.coalesce(F.when(dated, strip(F.regexp_extract("_b", day, 1))).otherwise(F.col("_b")), F.lit("")).alias("DESCRIPT"),
        F.coalesce(F.regexp_extract("_b", day, 2), F.lit("")).alias("APPROVAL_DATE"),
        *[part(figures, i).alias(n) for i, n in enumerate(first)],
        *[part(more, i).alias(n) for i, n in enumerate(last)],
    )


_LOND2397 = (
    "SL_NO PRODUCT_SUBPRODUCT_TYPE ACCOUNT_NUMBER NAME_OF_BORROWER LIMIT_AMOUNT DRAWING_POWER OUTSTANDING "
    "IRREGULARITY DATE_OF_COMMENCEMENT AUTHORISING_OFFICIAL_ID"
).split()


def excess_draw(lines: DataFrame) -> DataFrame:
    rows = body(lines, rules="-=| ").filter(bare_text().startswith("|") & bare_text().endswith("|"))
    return piped(rows, _LOND2397, first=1, at_least=12, source=bare_text()).filter(digits_only(F.col("SL_NO")))


# ---------------------------------------------------------------- general ledger

glcc_summary = fixed_width(
    "GL_CLASS_CODE:0-38 ACT_TOTAL:39-50 NAME:51-90 TOTAL_AMOUNT:91-111 TOTAL_INTEREST:112-131 "
    "TOTAL_DR_OD_INT:132-151 TOTAL_UNCLEARED_AMT:152-171 TOTAL_COLLECTION_AMT:172-",
    marker="-", nth=1, key="GL_CLASS_CODE", titles=("TOTAL", "CLASS"),
)

_GLCC_BAL = spans(
    "SLNO:0-9 CUSTOMER:10-27 ACCOUNT:28-42 NAME_OF_ACCOUNT:43-73 DR_BALANCE:74-91 CR_BALANCE:92-109 "
    "INT_BALANCE:110-123 RATE:124-132 OD_DR_INT_BAL:133-147 UNCLRED_BAL:148-163 COLL_AMT:164-"
)


def glcc_balances(lines: DataFrame) -> DataFrame:
    rows = body(lines, "-", 1)
    header = bare_text().startswith("GL CLASS CODE")
    fourth = part(F.split(bare_text(), r"\s+"), 3)
    rows = carried(rows, {"GL_CLASS_CODE": F.when(header & (fourth != ""), fourth)}).filter(~header)
    rows = sliced(rows, _GLCC_BAL, keep=["GL_CLASS_CODE"]).filter("SLNO <> '' OR CUSTOMER <> ''")
    return rows.filter(
        ~has_any(F.upper("SLNO"), ("SLNO", "NO OF", "GRANT", "TOTAL")) & ~F.upper("CUSTOMER").contains("TOTAL")
    )


_LOAN_DET = spans(
    "SLNO:0-10 CUSTOMER:10-28 ACCOUNT:28-42 NAME_OF_ACCOUNT:42-80 DR_BALANCE:80-100 CR_BALANCE:100-113 "
    "_INT:113-136 INT_YTD_CY:136-155 INT_YTD_PY:155-175 UNPD_INT:175-"
)
_GL_DET = spans("SLNO:0-8 ACCOUNT_NO:8-27 LEDGER_NAME:27-61 CURRENCY:61-71 DR_BALANCE:71-93 CR_BALANCE:93-")


def _under_gl_class(lines: DataFrame, values) -> DataFrame:
    rows = without_boilerplate(lines).withColumn("text", strip(raw_line()))
    rows = rows.filter((bare_text() != "") & ~raw_line().contains("====>") & ~raw_line().contains("TOTAL") & ~bare_text().startswith("-"))
    header = raw_line().startswith("GL CLASS CODE")
    title = after(raw_line(), "GL CLASS CODE")
    return carried(rows, {n: F.when(header, v) for n, v in values(title).items()}).filter(~header)


def loan_gl_detail(lines: DataFrame) -> DataFrame:
    rows = _under_gl_class(lines, lambda t: {
        "GL_CLASS_CODE": F.regexp_extract(t, r"^(\S*)", 1),
        "PRODUCT_NAME": strip(F.regexp_extract(t, r"^\S* (.*)$", 1)),
    })
    rows = sliced(rows, _LOAN_DET, keep=["GL_CLASS_CODE", "PRODUCT_NAME"]).filter(digits_only(F.col("SLNO")))
    both = F.split("_INT", r"\s+")
    return rows.withColumns({"INT_BALANCE": part(both, 0), "INT_RATE": part(both, 1)}).drop("_INT")


def gl_detail(lines: DataFrame) -> DataFrame:
    rows = _under_gl_class(lines, lambda t: {"GL_CLASS_CODE": t})
    return sliced(rows, _GL_DET, keep=["GL_CLASS_CODE"]).filter(digits_only(F.col("SLNO")))


def loan_gl_summary(lines: DataFrame) -> DataFrame:
    rows = without_boilerplate(lines).filter(
        ~raw_line().contains("====>") & ~raw_line().startswith("GL CLASS CODE") & (F.length(raw_line()) > 40)
    )
    pieces = F.split(cut(raw_line(), 51, 116), r"\s{2,}")
    return rows.select(
        "path", "line_no", cut(raw_line(), 0, 40).alias("GL_CLASS_CODE"), cut(raw_line(), 40, 51).alias("ACT_TOTAL"),
        part(pieces, 0).alias("NAME"), part(pieces, 1).alias("TOTAL_AMOUNT"), cut(raw_line(), 116).alias("TOTAL_INTEREST"),
    ).filter(digits_only(F.col("ACT_TOTAL")))


_GNBD7376 = (
    "S_NO ACCOUNT_NO CASH_CREDIT CASH_DEBIT CLEARING_CREDIT CLEARING_DEBIT TRANSFER_CREDIT TRANSFER_DEBIT "
    "PRODUCT_TOTAL_CREDIT PRODUCT_TOTAL_DEBIT"
).split()


def daily_productwise(lines: DataFrame) -> DataFrame:
    rows = body(lines, rules="-_")
    header = bare_text().contains("PROD CODE") & bare_text().contains("PROD DESC")
    title = r"PROD CODE\s*:\s*(.*?)\s*PROD DESC\s*:\s*(.*)"
    named = header & bare_text().rlike(title)
    rows = carried(rows, {
        "PROD_CODE": F.when(named, strip(F.regexp_extract(bare_text(), title, 1))),
        "PROD_DESC": F.when(named, strip(F.regexp_extract(bare_text(), title, 2))),
    }).filter(~header & ~has_any(bare_text(), ("ACCOUNT NO'S", "S.NO.", "TOTALS FOR PRODUCT")) & raw_line().contains("|"))
    rows = piped(rows, _GNBD7376, first=0, at_least=10, keep=["PROD_CODE", "PROD_DESC"])
    return rows.filter("S_NO <> '' OR ACCOUNT_NO <> ''")


def bgl_enquiry(lines: DataFrame) -> DataFrame:
    rows = sliced(without_boilerplate(lines), spans(
        "S1_NO:0-5 BRANCH:5-14 TERM:14-20 USER:20-31 TXN_CODE:31-40 POST_DATE:40-53 TRACE_NO:53-67 AMOUNT_DR:67-90 "
        "AMOUNT_CR:90-113 BALANCE:113-137 STATEMENT_NARRATIVE:137-190 REFERENCE_NO:190-"
    ))
    return rows.filter(digits_only(F.col("S1_NO")))


_DAYBOOK = spans(
    "_HOME:61-67 VALUE_DATE:68-80 TXN_TYPE:80-102 CHEQUE_NO:102-125 DEBIT:125-150 CREDIT:150-170 USER_ID:170-180 "
    "CHK1_ID:180-195 CHK2_ID:195-205 SUP_ID:205-"
)


def gl_daybook(lines: DataFrame) -> DataFrame:
    rows = body(lines, "-_", 2).filter(printable(bare_text()))
    squeezed = F.regexp_replace(F.upper(bare_text()), r"\s+", " ")
    rows = rows.filter(
        ~has_any(squeezed, ("ACCOUNT NAME", "VALUE DATE", "TXN TYPE", "ACCOUNT TOTAL", "CHEQUE NO"))
        & ~bare_text().startswith("NUMBER")
        & ~(bare_text().startswith("ACCOUNT") & has_any(raw_line(), ("HOME", "TYPE", "DESCRIPTION")))
        & ~has_any(bare_text(), ("TION REPOR", "NIL REPORT"))
    )
    number = cut(raw_line(), 0, 19)
    opens = (number != "") & ~number.startswith("NIL REPORT") & ~F.upper(number).contains("TOTAL")
    rows = carried(rows, {
        "ACCOUNT_NUMBER": F.when(opens, number), "ACCOUNT_NAME": F.when(opens, cut(raw_line(), 20, 60)),
        "_branch": F.when(opens, cut(raw_line(), 61, 67)),
    }).filter((cut(raw_line(), 68) != "") & ~raw_line().contains("---"))
    rows = sliced(rows, _DAYBOOK, keep=["ACCOUNT_NUMBER", "ACCOUNT_NAME", "_branch"])
    home = F.coalesce(F.nullif(F.col("_HOME"), F.lit("")), F.col("_branch"))
    rows = rows.filter("concat(VALUE_DATE, TXN_TYPE, DEBIT, CREDIT, USER_ID) <> ''")
    return rows.withColumn("HOME_BRANCH", home).drop("_HOME", "_branch")


gl_outstanding = row_pattern(
    r"^\s*([\w-]+)\s+(.+?)\s+(\d{2}-\d{2}-\d{4})\s+(\d{2}-\d{2}-\d{4})\s+([A-Z0-9]+)\s+([A-Z0-9]+)\s+"
    r"([-\d.,]+\s*(?:CR|DR)?)\s+([A-Z0-9]{3})\s*$",
    "ACCOUNT_NO ACCT_PARTICULARS ISSUE_DATE VALUE_DATE REF_NUMBER TRAN_NO AMOUNT REM",
    marker="-=", skip=["ACCOUNT TOTAL", "BRANCH TOTAL"], on_line=True,
)

audit_bgl_ageing = row_pattern(
    r"^\s*([\w-]+)\s+(.+?)\s+(\d{5})\s+([A-Z0-9]+)\s+(\d{2}-\d{2}-\d{4})\s+([A-Z]{3})\s+([-\d.,]+\s*(?:CR|DR)?)\s*(.*?)\s*(\d+)$",
    "ACCOUNT_NO ACCOUNT_NAME BRANCH_NO REFERENCE_NO POST_DATE ENTRY_TYPE AMT_OUTSTD DESC AGE_DAYS",
    marker="-=", skip_upper=["TOTAL"], on_line=True,
)


def suspense_ageing(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("text", strip(raw_line()))
    titled = bare_text().contains("ACCOUNT NO:") & bare_text().contains("ACCOUNT NAME:")
    number = strip(F.substring_index(F.substring_index(F.split_part(raw_line(), F.lit("ACCOUNT NO:"), F.lit(2)), "ACCOUNT NAME:", 1), "\n", 1))
    label = strip(F.replace(F.split_part(raw_line(), F.lit("ACCOUNT NAME:"), F.lit(2)), F.lit("|"), F.lit("")))
    money = strip(F.replace(F.split_part(raw_line(), F.lit("CURRENCY:"), F.lit(2)), F.lit("|"), F.lit("")))
    rows = carried(rows, {
        "ACCOUNT_NO": F.when(titled, number), "ACCOUNT_NAME": F.when(titled, label),
        "CURRENCY": F.when(bare_text().contains("CURRENCY:"), money),
    })
    rows = rows.filter((bare_text() != "") & ~made_of(bare_text(), "|- ") & ~has_any(raw_line(), (
        "| SR. NO.", "NO. OF DAYS", "TOTAL OUTSTANDING AMOUNT", "BALANCE THE ABOVE ACCOUNTS", "TOTAL BALANCE OF BGL",
        "REPORT ID:", "PAGE NO :", "BRANCH-CODE:", "AGEWISE BREAKUP", "BANKER CHEQUE",
    )) & bare_text().startswith("|") & bare_text().endswith("|"))
    rows = piped(rows, "SR_NO JOURNAL_NO JOURNAL_DATE INSTRUMENT_ACCOUNT_NO AMOUNT AGE_DAYS".split(), 1, 7,
                 keep=["ACCOUNT_NO", "ACCOUNT_NAME", "CURRENCY"])
    return rows.filter(digits_only(F.col("SR_NO")) | (F.col("AMOUNT") != ""))


expense_credit = fixed_width(
    "ACCOUNT_NUMBER:0-18 DESCRIPTION:19-64 TXN_AMOUNT:65-88 BALANCE:89-", key="ACCOUNT_NUMBER")
income_debit_txns = fixed_width(
    "ACCOUNT_NO:0-19 DATE:19-33 TXN_AMOUNT:33-49 DESCRIPTION:49-95 MAKER_ID:95-107 CHECKER_ID:107-", key="ACCOUNT_NO")

# ---------------------------------------------------------------- journals and transactions

_NOTES = ("*Note:", "For other enteries", "Please confirm")


def journal_check(lines: DataFrame) -> DataFrame:
    rows = body(lines, "-_", 2)
    rows = rows.filter(~raw_line().startswith("NIL REPORT") & ~has_any(F.upper(raw_line()), ("TOTAL", "JRNL NO", "SUM ")))
    rows = ordered.before_marker(rows, has_any(raw_line(), _NOTES))
    return sliced(rows, spans(
        "JRNL_NO:0-11 TXN_NO:11-17 DESCRIPTION:17-48 ACCOUNT_NO:48-62 GLCC_CODE:62-82 TXN_TIME:82-95 AMOUNT:95-110 "
        "AMOUNT_IN_TECH_CONT:110-"
    )).filter("JRNL_NO <> '' OR AMOUNT <> ''")


def journal_amounts(lines: DataFrame) -> DataFrame:
    rows = ordered.before_marker(body(lines, "-_", 2), has_any(raw_line(), _NOTES))
    return without_titles(sliced(rows, spans("JOURNAL_NO:0-27 LCY_AMOUNT:28-")), "JOURNAL_NO", ("TOTAL", "JRNL NO"))


_BRANCH_TXN = spans(
    "SR_NO:0-8 OTH_BRCH:8-17 CUSTOMER_NAME:17-43 ACCOUNT_NO:43-59 PRODUCT_NAME:59-90 TXN_CODE:90-108 T_DR_AMT:108-133 "
    "T_CR_AMT:133-149 MK_ID:149-159 CK_ID:159-"
)


def interbranch(lines: DataFrame) -> DataFrame:
    noise = has_any(bare_text(), ("TOTAL:", "No Internet Banking Transactions", "No BGL Transactions")) | has_any(
        F.upper(bare_text()), ("INTERNET BANKING", "BGL TRANSACTIONS"))
    rows = body(lines, "-_", 2).filter(~noise & printable(bare_text()))
    rows = rows.filter(~(bare_text().contains("SR.NO") & bare_text().contains("CUSTOMER NAME")))
    return sliced(rows, _BRANCH_TXN).filter("SR_NO <> '' OR ACCOUNT_NO <> ''")


def interbranch_by_us(lines: DataFrame) -> DataFrame:
    rows = body(lines, "-_", 2).filter(printable(bare_text()))
    return rows.select("path", "line_no", bare_text().alias("RAW_LINE"))


_NON_HOME = spans(
    "SR_NO:0-6 OTHER_BRANCH_CODE:7-25 CUSTOMER_NAME:26-91 ACCOUNT_NUMBER:92-107 PRODUCT_NAME:108-139 TXN_CODE:140-157 "
    "TXN_DEBIT_AMOUNT:158-182 TXN_CREDIT_AMOUNT:183-201 MAKER_ID:202-211 CHECKER_ID:212-"
)
_NON_HOME_BRANCH = r"^BRANCH\s+NO\s*:\s*(\d+)\s+BRANCH\s+NAME\s*:\s*(.+?)(?:\s{3,}PAGE\s+NO|$)"


def non_home_branch(lines: DataFrame) -> DataFrame:
    rows = body(lines, rules="-=<>| ", boilerplate=True, skip=["TOTAL:"], skip_upper=[
        "REPORT ID", "AREA:", "RUN DATE", "PROC DATE", "PAGE NO", "SR.NO", "OTHER-BRANCH-CODE", "TRANSACTIONS POSTED",
        "** END", "GRAND TOTAL",
    ]).filter(~bare_text().rlike(r"^[\x1b\x0c]"))
    header = bare_text().rlike(_NON_HOME_BRANCH)
    rows = carried(rows, {
        "BRANCH_CODE": F.when(header, padded(F.regexp_extract(bare_text(), _NON_HOME_BRANCH, 1))),
        "BRANCH_NAME": F.when(header, strip(F.regexp_extract(bare_text(), _NON_HOME_BRANCH, 2))),
    }).filter(~header)
    rows = sliced(rows, _NON_HOME, keep=["BRANCH_CODE", "BRANCH_NAME"])
    return rows.filter(digits_only(F.col("SR_NO")) & (F.col("ACCOUNT_NUMBER") != ""))


_VOUCHER_NOISE = (
    "-----", "VOUCHER VERIFICATION", "PAGE NO", "REPORT ID", "AREA:", "TELLER NAME  :", "CURRENCY : INR",
    "CHECKER ID :", "BRANCH CODE :",
)


def _vouchers(lines: DataFrame, headers: tuple[str, ...], opens_at: str) -> tuple[DataFrame, object]:
    rows = lines.filter(~has_any(raw_line(), _VOUCHER_NOISE + headers) & (strip(raw_line()) != ""))
    opens = F.substring(raw_line(), 1, 20).rlike(opens_at)
    return ordered.records(rows, opens), opens


def _joined_name(rows: DataFrame, is_piece, start: int, end: int):
    """Name cells of a record's lines in line order, single-spaced between lines."""
    pieces = F.array_sort(F.collect_list(F.when(is_piece, F.struct("line_no", cut(raw_line(), start, end).alias("v")))))
    return strip(F.array_join(F.transform(pieces, lambda p: p["v"]), " "))


def vouchers_0331(lines: DataFrame) -> DataFrame:
    rows, opens = _vouchers(
        lines, ("ACCOUNT    CUSTOMER NAME", "NUMBER                                            BRANCH"), r"^\s{2,10}\d{10,16}")
    detail = ~opens & (F.length(raw_line()) > 75) & cut(raw_line(), 69, 79).rlike(r"^\d{2}/\d{2}/\d{4}")
    figures = spans(
        "VALUE_DATE:69-81 TXN_DESC:81-103 CHEQUE_NO:103-120 DEBIT:120-144 CREDIT:144-165 USER_ID:165-179 CHK1_ID:179-184 "
        "CHK2_ID:184-195 SUP_ID:195-202"
    )
    wide = rows.groupBy("path", "record").agg(
        F.max(F.when(opens, raw_line())).alias("_first"),
        F.max_by(raw_line(), F.when(detail, F.col("line_no"))).alias("_detail"),
        _joined_name(rows, ~detail, 21, 61).alias("CUSTOMER_NAME"),
    )
    first, last = F.col("_first"), F.coalesce("_detail", F.lit(""))
    return wide.select(
        "path", F.col("record").alias("line_no"), cut(first, 0, 21).alias("ACCOUNT_NUMBER"), "CUSTOMER_NAME",
        cut(first, 61, 69).alias("HOME_BRANCH"), *[cut(last, a, b).alias(n) for n, (a, b) in figures.items()],
        cut(first, 195).alias("PRODUCT_DESC"),
    ).filter("ACCOUNT_NUMBER <> ''")


def vouchers_0344(lines: DataFrame) -> DataFrame:
    rows, opens = _vouchers(
        lines, ("ACCOUNT      CUSTOMER NAME", "NUMBER                                       BRNCH"), r"^\s{0,5}\d{10,16}")
    figures = spans(
        "ACCOUNT_NUMBER:0-16 HOME_BRANCH:48-54 VALUE_DATE:54-64 TXN_DESC:64-81 CHEQUE_NO:81-111 DEBIT:111-125 "
        "CREDIT:125-143 USER_ID:143-151 CHK1_ID:151-159 CHK2_ID:159-167 SUP_ID:167-175 PRODUCT_DESC:175-"
    )
    wide = rows.groupBy("path", "record").agg(
        F.max(F.when(opens, raw_line())).alias("_first"), _joined_name(rows, F.lit(True), 16, 48).alias("CUSTOMER_NAME")
    )
    return wide.select(
        "path", F.col("record").alias("line_no"), "CUSTOMER_NAME",
        *[cut(F.col("_first"), a, b).alias(n) for n, (a, b) in figures.items()],
    ).filter("ACCOUNT_NUMBER <> ''")


def supplementary(lines: DataFrame) -> DataFrame:
    """The account number anchors the line: credits to its left, name and debits to its right."""
    rows = body(lines, "-_= <>|", 2).filter(printable(bare_text()) & ~inferred.is_header(bare_text()))
    anchor = r"^(.*?)(?:\s|^)(\d{12,20})\s"
    rows = rows.filter(raw_line().rlike(anchor))
    number = F.regexp_extract(raw_line(), anchor, 2)
    at = F.instr(raw_line(), number)
    credits = F.split(strip(F.expr("substring(line, 1, _at - 1)")), r"\s+")
    ids = F.split(cut(raw_line(), 182), r"\s+")
    count = F.when(part(ids, 0) == "", 0).otherwise(F.size(ids))
    rows = rows.withColumns({"_no": number, "_at": at})
    name = strip(F.expr("substring(line, _at + length(_no), greatest(120 - (_at - 1 + length(_no)), 0))"))
    return rows.select(
        "path", "line_no", part(credits, -3).alias("CREDIT_CASH"), part(credits, -2).alias("CREDIT_CLEARING"),
        part(credits, -1).alias("CREDIT_TRANSFER"), F.col("_no").alias("ACCOUNT_NO"), name.alias("CUSTOMER_NAME"),
        cut(raw_line(), 120, 142).alias("DEBIT_CASH"), cut(raw_line(), 142, 155).alias("DEBIT_CLEARING"),
        cut(raw_line(), 155, 177).alias("DEBIT_TRANSFER"), cut(raw_line(), 177, 182).alias("CHEQUENO"),
        F.when(count >= 3, part(ids, -3)).otherwise("").alias("MAKERID"),
        F.when(count >= 2, part(ids, -2)).otherwise(part(ids, -1)).alias("CHK1ID"),
        F.when(count >= 2, part(ids, -1)).otherwise("").alias("CHK2ID"),
    )


def system_generated(lines: DataFrame) -> DataFrame:
    rows = without_boilerplate(lines).withColumn("text", strip(raw_line())).filter("text <> ''")
    title = has_any(raw_line(), ("PRODUCT  DESCRIPTION  :", "PRODUCT DESCRIPTION :"))
    rows = carried(rows, {"PRODUCT_NAME": F.when(title, strip(F.split_part(raw_line(), F.lit(":"), F.lit(2))))})
    rule = made_of(bare_text(), "-=")
    rows = ordered.after_marker(rows, rule).filter(
        ~rule & ~title & ~F.upper(bare_text()).contains("PROD TOTAL") & bare_text().rlike(r"^\d{10,16}"))
    return sliced(rows, spans(
        "ACCOUNT_NUMBER:0-21 CUSTOMER_NAME:21-60 TRANSACTION_DESCRIPTION:60-98 TXN_DATE:98-114 TRANSACTION_AMOUNT:114-140"
    ), keep=["PRODUCT_NAME"])


def system_transactions(lines: DataFrame) -> DataFrame:
    rows = without_boilerplate(lines).withColumn("text", strip(raw_line())).filter("text <> ''")
    rule = made_of(bare_text(), "-=") | bare_text().startswith("---")
    rows = ordered.after_marker(rows, rule).filter(
        ~rule & ~has_any(raw_line(), ("PRODUCT TOTAL", "GRAND TOTAL", "REPORT ID", "BRANCH NO", "PAGE NO", "SNO"))
        & raw_line().rlike(r"^\s*\d+\s+") & (F.length(raw_line()) > 166))
    return sliced(rows, spans(
        "SNO:0-4 ACCOUNT_TYPE:4-13 INTEREST_CATEGORY:13-23 PRODUCT_DESCRIPTION:23-55 ACCOUNT_NUMBER:55-73 "
        "CUSTOMER_NAME:73-109 CREDIT_AMOUNT:109-130 DEBIT_AMOUNT:130-150 AVAILABLE_BALANCE:150-166 TRANSACTION_NARRATION:166-"
    )).filter("ACCOUNT_NUMBER <> ''")


high_value_transactions = row_pattern(
    r"^\s*(\d+)\s+(\d+)\s+(.+?)\s+(\d{2}-\d{2}-\d{4})\s+([\d,]+\.\d{2}-?)\s*(.*)$",
    "SR_NO ACCOUNT_NO ACCOUNT_NAME TRANS_DATE AMOUNT NARRATION",
    rules="-=[c]", skip_upper=["REPORT ID", "BRANCH CODE", "PAGE NO", "DATE", "TOTAL", "SR.NO"],
)

# ---------------------------------------------------------------- exceptions and audits

_BREACH = (
    r"^(\d+)\s+(\d+)\s+(\d+)\s+([\d-]+)\s+([\d,]+\.\d{2})\s+(\d+)\s+(\d+)\s*(.*?)\s+([\d,]+\.\d{2}[+-]?)\s+([\d\.]+)"
    r"(?:\s+(.*))?$"
)
_BREACH_FIELDS = (
    "TRAN_CODE RESULT JRNL_NO ACCOUNT_NO AMOUNT SUP_ID SUP_ERR_NO ERROR_DESC OUTSTANDING LIMIT_AMOUNT CUSTOMER_NAME"
).split()


def limit_breaches(lines: DataFrame) -> DataFrame:
    """Pattern first; lines that drifted out of it are split on wide gaps from both ends."""
    rows = body(lines, rules="=-_")
    header = bare_text().contains("TRAN-CODE") & bare_text().contains("RESULT")
    rows = ordered.after_marker(rows, header).filter(~header & ~(bare_text().contains("EXCEPTION") & bare_text().contains("REPORT")))
    fits = bare_text().rlike(_BREACH)
    cells = F.split(bare_text(), r"\s{2,}")
    spare = dict(zip(_BREACH_FIELDS, [0, 1, 2, 3, 4, 5, 6, None, -3, -2, -1]))
    return rows.filter(fits | (F.size(cells) >= 8)).select(
        "path", "line_no",
        *[F.when(fits, strip(F.regexp_extract(bare_text(), _BREACH, i)))
          .otherwise(F.lit("") if spare[n] is None else part(cells, spare[n])).alias(n)
          for i, n in enumerate(_BREACH_FIELDS, 1)],
    )


def rate_variation(lines: DataFrame) -> DataFrame:
    rows = body(lines, "-_", 1).filter(
        ~(bare_text().contains("ACCOUNT") & bare_text().contains("CUSTOMER NAME")) & ~(bare_text().contains("NUMBER") & bare_text().contains("AMOUNT")))
    return sliced(rows, spans(
        "ACCOUNT_NUMBER:5-20 CUSTOMER_NAME:20-70 SANCTION_AMOUNT:70-85 ACCT_TYPE:85-92 SUB_TYPE:92-100 "
        "PRODUCT_INT_RATE:100-112 EFFECTIVE_INT_RATE:112-"
    )).filter("ACCOUNT_NUMBER <> '' OR CUSTOMER_NAME <> ''")


lien_operations = row_pattern(
    r"^\s*(\d+)\s+([\w-]+)\s+(.+?)\s{2,}([-\d.,]+)\s{2,}(.+?)\s{2,}(MARK|REM|MARK/REM)\s+(\w+)\s+(\w+)\s*$",
    "SR_NO ACCOUNT_NO TYPE_OF_ACCOUNT LIEN_AMOUNT REASON MARK_REM USER_ID CHK_ID", marker="-=", on_line=True,
)
rate_changes = row_pattern(
    r"^\s*(\d+)\s+(\d{12,16})\s+(.+?)\s+(\d+)\s+([\d,]+\.\d{2})\s+(\d{2}/\d{2}/\d{4})\s+([\d\.]+)\s+([\d\.]+)\s*$",
    "SL_NO ACCOUNT_NO CUSTOMER_NAME AC_TYPE ACCOUNT_BALANCE VALUE_DATE OLD_INT_RATE NEW_INT_RATE",
    rules="-=| ", skip_upper=["REPORT ID", "BRANCH CODE", "PAGE NO", "DATE", "SL NO."],
)

# ---------------------------------------------------------------- users, stationery, securities, members

least_active_ids = fixed_width(
    "SL_NO:0-15 ID:15-30 NO_OF_TXNS_DEBIT:30-50 NO_OF_TXNS_CREDIT:50-61 MEMO_HITS:61-", key="SL_NO",
    skip=["TOT VOUCH", "TOTAL", "SL-NO"],
)
idle_users = row_pattern(
    r"^\s*(\d+)\s+(\d+)\s+(.+?)\s*$", "SL_NO ID USER_NAME", rules="-=<>|", skip=["TOTAL:"],
    skip_upper=["REPORT ID", "BRANCH CODE", "PAGE NO", "DATE", "SL-NO", "MANAGEMENT CONTROL SYSTEM"],
)


def home_branch_users(lines: DataFrame) -> DataFrame:
    names = (
        "USER_ID USER_NAME USER_CAPABILITY_LEVEL DATA_SECURITY_LEVEL DATA_SECURITY_GROUP USER_STATUS DESIGNATION DIVISION"
    ).split()
    return without_titles(gaps(body(lines, "-_", 2), names), "USER_ID")


def inventory_received(lines: DataFrame) -> DataFrame:
    period = r"FROM\s+(\d{2}/\d{2}/\d{4})\s+TO\s+(\d{2}/\d{2}/\d{4})"
    titled = raw_line().contains("DETAILS OF INVENTORY RECEIVED") & raw_line().rlike(period)
    dates = lines.filter(titled).groupBy("path").agg(F.min_by("line", "line_no").alias("_title")).select(
        "path", F.regexp_extract("_title", period, 1).alias("FROM_DATE"), F.regexp_extract("_title", period, 2).alias("TO_DATE"))
    rows = without_boilerplate(lines).withColumn("text", strip(raw_line())).filter("text <> ''")
    rule = made_of(bare_text(), "-=") | bare_text().startswith("---")
    rows = ordered.after_marker(rows, rule).filter(
        ~rule & ~(raw_line().contains("INVENTORY") & raw_line().contains("DATE OF")) & ~(raw_line().contains("CATEGORY") & raw_line().contains("RECEIPT"))
        & ~has_any(raw_line(), ("REPORT ID", "BRANCH CODE", "PAGE NO")))
    wide = spans(
        "INVENTORY_CATEGORY:0-31 DATE_OF_RECEIPT:31-43 PREFIX:43-61 SERIAL_NO_FROM:61-71 SERIAL_NO_TO:71-81 PIECES:81-92 "
        "OPENING_BALANCE:92-104 CLOSING_BALANCE:104-"
    )
    cells = F.split(bare_text(), r"\s{2,}")
    spare = {"INVENTORY_CATEGORY": 0, "DATE_OF_RECEIPT": 1, "PREFIX": 2, "OPENING_BALANCE": -2, "CLOSING_BALANCE": -1}
    long = F.length(raw_line()) > 100
    rows = rows.filter(long | (F.size(cells) >= 5)).select(
        "path", "line_no",
        *[F.when(long, cut(raw_line(), a, b)).otherwise(part(cells, spare[n]) if n in spare else F.lit("")).alias(n)
          for n, (a, b) in wide.items()],
    ).filter("INVENTORY_CATEGORY <> ''")
    blank = {"FROM_DATE": "", "TO_DATE": ""}
    return rows.join(dates, "path", "left").fillna(blank)


# Names for branches whose number stands alone in the stationery report.
_KNOWN_BRANCHES = {"00001": "HEAD OFFICE", "00002": "RAIL HEAD COMPLEX", "00005": "ARNAS", "00007": "BANIHAL"}


def stationery(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("text", strip(raw_line()))
    bare = strip(F.replace(F.replace(bare_text(), F.lit("BRANCH NO :"), F.lit("")), F.lit("|"), F.lit("")))
    kind = strip(F.replace(F.replace(bare_text(), F.lit("INSTRUMENT TYPE:"), F.lit("")), F.lit("|"), F.lit("")))
    code = F.when(bare_text().startswith("BRANCH NO :") & digits_only(bare), padded(bare))
    rows = carried(rows, {"BRANCH_CODE": code, "INSTRUMENT_TYPE": F.when(bare_text().startswith("INSTRUMENT TYPE:"), kind)})
    closes = has_any(raw_line(), ("INSTRUMENT TYPE:", "BRANCH NO :", "REPORT-ID:"))
    rows = between(rows, raw_line().contains("SR. NO.|  PREFIX  |"), closes).filter((bare_text() != "") & ~made_of(bare_text(), "-|="))
    names = "SR_NO PREFIX SERIAL_NO LEAVES CAT SUB_CAT MICR STATUS CURRENCY TELLER_NO".split()
    cells = F.split(raw_line(), r"[-|]")
    label = F.lit("")
    for known, text in _KNOWN_BRANCHES.items():
        label = F.when(F.col("BRANCH_CODE") == known, text).otherwise(label)
    # The reference fills this name only where the header gives none; see ``attach_stationery``.
    return rows.filter(F.size(cells) >= 10).select(
        "path", "line_no", "BRANCH_CODE", label.alias("_known_name"), "INSTRUMENT_TYPE",
        *[strip(part(cells, i)).alias(n) for i, n in enumerate(names)],
    ).filter(digits_only(F.col("SR_NO")))


cheque_book_orders = row_pattern(
    r"^\s*([\w-]+)\s+(.+?)(?:\s+(\d+)\s+(\d+))?\s+(\d{1,5})\s+(\d{2}/\d{2}/\d{4})\s*(?:\s+(\d{2}/\d{2}/\d{4}))?\s+([A-Za-z]+)\s+(\d+)\s*$",
    "ACCOUNT_NUMBER CUSTOMER_NAME CHEQUE_NO_FROM CHEQUE_NO_TO NO_OF_LEAVES ORDER_DATE ISSUE_DATE STATUS TELLER_NUMBER",
    marker="-=", skip=["ACCOUNT NUMBER", "CUSTOMER NAME", "TELLER"], on_line=True,
)
branch_opened_accounts = row_pattern(
    r"^\s*(\d+)\s+([\d-]+)\s+(\d+)\s+(.+?)\s+(\d{2}/\d{2}/\d{4})\s+(\d+)\s*$",
    "S_NO TYPE_OF_ACCOUNT ACCOUNT_NUMBER ACCOUNT_NAME DATE_OF_OPENING VERIFYING_OFFICIAL", marker="-=",
    skip=["S. NO.", "PAGE TOTAL", "TOTAL BRANCH ACCOUNTS"], on_line=True,
)


def matured_securities(lines: DataFrame) -> DataFrame:
    rows = without_boilerplate(lines).filter(strip(raw_line()).rlike(r"^[0-9]{1,5}(\s|$)"))
    return sliced(rows, spans(
        "SR_NO:0-6 ACCOUNT_NO:7-23 CUSTOMER_NAME:23-53 SYSTEM:53-59 LOAN_ACCNT_NO:59-75 COLLATERAL_NO:75-91 "
        "ISSUE_DATE:91-102 VALUE_OF_SECURITY:102-118 MATURITY_PERIOD:118-123 MATURITY_DATE:123-"
    ))


def customer_members(lines: DataFrame) -> DataFrame:
    rows = without_boilerplate(lines).withColumn("text", strip(raw_line())).filter("text <> ''")
    rows = ordered.after_marker(rows, made_of(bare_text(), "_|") & bare_text().contains("_"))
    rows = rows.filter(~(made_of(bare_text(), "_|") & bare_text().contains("_")) & ~raw_line().contains("|"))
    return sliced(rows, spans(
        "SERIAL_NO:0-6 CUSTOMER_NUMBER:7-25 NAME_OF_CUSTOMER:26-87 MEMBERSHIP_NUMBER:88-107 MEMBERSHIP_TYPE:108-129 "
        "IS_TDS_APPLICABLE:130-141 MEMBERSHIP_DATE:142-"
    )).filter("SERIAL_NO <> '' OR CUSTOMER_NUMBER <> ''")


# ---------------------------------------------------------------- maturities, notices, letters

def maturity_list(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("text", strip(raw_line()))
    at_branch = raw_line().contains("BRANCH CODE") & raw_line().contains("BRANCH NAME")
    left = F.split_part(raw_line(), F.lit("BRANCH NAME"), F.lit(1))
    code = strip(F.replace(F.replace(left, F.lit("BRANCH CODE :"), F.lit("")), F.lit("BRANCH CODE"), F.lit("")))
    label = strip(F.regexp_replace(F.split_part(raw_line(), F.lit("BRANCH NAME"), F.lit(2)), r"\d+$", ""))
    at_product = raw_line().contains("PRODUCT TYPE:") & raw_line().contains("ACCOUNT CATEGORY:")
    product = after(F.split_part(raw_line(), F.lit("ACCOUNT CATEGORY:"), F.lit(1)), "PRODUCT TYPE:")
    rows = carried(rows, {
        "BRANCH_CODE": F.when(at_branch, code), "BRANCH_NAME": F.when(at_branch, label),
        "PRODUCT_TYPE": F.when(at_product, product),
        "ACCOUNT_CATEGORY": F.when(at_product, strip(F.split_part(raw_line(), F.lit("ACCOUNT CATEGORY:"), F.lit(2)))),
    })
    rows = rows.filter(~at_product & (bare_text() != "") & ~made_of(bare_text(), "- =") & (F.length(raw_line()) > 60) & ~has_any(bare_text(), (
        "REPORT ID:", "AREA:", "TERM DEPOSIT MATURITY REPORT", "BRANCH CODE", "ACCOUNT NUMBER CURRENCY", "CUSTOMER TOTAL",
        "PRODUCT TOTAL", "BRANCH TOTAL", "GRAND TOTAL",
    )))
    return sliced(rows, spans(
        "ACCOUNT_NUMBER:0-17 CURRENCY:17-25 CUSTOMER_NAME:25-70 DEPOSIT_AMOUNT:70-90 INTEREST_RATE:90-101 MATURITY_DATE:101-"
    ), keep=["BRANCH_CODE", "BRANCH_NAME", "PRODUCT_TYPE", "ACCOUNT_CATEGORY"]).filter(digits_only(F.col("ACCOUNT_NUMBER")))


def maturity_advice(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("text", strip(raw_line()))
    cif = r"\(([0-9]{10,14})\)"
    subject = "SUBJECT : TERM ACCOUNT(S) MATURING ON "
    rows = carried(rows, {
        "CIF_NO": F.when(raw_line().rlike(cif), F.regexp_extract(raw_line(), cif, 1)),
        "CUSTOMER_NAME": F.when(raw_line().rlike(cif), strip(F.regexp_extract(raw_line(), r"^(.*?)\([0-9]{10,14}\)", 1))),
        "SUBJECT_DATE": F.when(raw_line().contains(subject), strip(F.substring_index(raw_line(), "MATURING ON ", -1))),
    })
    closes = has_any(bare_text(), ("ASSURING YOU OF OUR BEST SERVICES", "Yours faithfully,", "Authorised Signatory"))
    rows = between(rows, raw_line().contains("ACCOUNT NO.  RECIEPT-NO  CURRENCY"), closes)
    rows = sliced(rows.filter(F.length(raw_line()) >= 91), spans(
        "ACCOUNT_NO:0-15 RECEIPT_NO:15-27 CURRENCY:27-40 TERM_VALUE:40-63 MAT_VALUE:63-74 MAT_DATE:74-86 ACCOUNT_STATUS:86-"
    ), keep=["CUSTOMER_NAME", "CIF_NO", "SUBJECT_DATE"])
    return rows.filter(digits_only(F.col("ACCOUNT_NO"))).withColumn("REPORT_ID", F.lit("ADVICEFORTD"))


def interest_projection(lines: DataFrame) -> DataFrame:
    """One customer block runs from a DATE line to its PAN line; the table below belongs to it."""
    rows = lines.withColumn("text", strip(raw_line()))
    branch = r"BRANCH\s*:\s*\((.*?)\)\s*(.*)"
    at_branch = raw_line().contains("BRANCH :") & raw_line().rlike(branch)
    opens, pan = raw_line().contains("DATE :"), bare_text().startswith("PAN NO:")
    birth = bare_text().startswith("BIRTH DATE:")
    rows = carried(rows, {
        "BRANCH_CODE": F.when(at_branch, strip(F.regexp_extract(raw_line(), branch, 1))),
        "BRANCH_NAME": F.when(at_branch, strip(F.regexp_extract(raw_line(), branch, 2))),
    })
    rows = ordered.carry_forward(rows, {"_block": F.when(opens, F.col("line_no"))})
    rows = ordered.carry_forward(rows.filter(~opens), {
        "_pan_of": F.when(pan, F.col("_block")),
        "_subject_of": F.when(bare_text().startswith("SUBJECT :"), F.col("_block")),
        "SUBJECT": F.when(bare_text().startswith("SUBJECT :"), after(bare_text(), "SUBJECT :")),
    })
    block = F.col("_block")
    head = block.isNotNull() & (bare_text() != "") & (~F.col("_pan_of").eqNullSafe(block) | pan)
    pieces = F.array_sort(F.collect_list(F.when(~birth & ~pan, F.struct("line_no", "text"))))
    heads = rows.filter(head).groupBy("path", block.alias("_block")).agg(
        pieces.alias("_p"),
        F.max_by(strip(F.replace(after(bare_text(), "BIRTH DATE:"), F.lit("-"), F.lit(""))), F.when(birth, F.col("line_no"))).alias("DOB"),
        F.min_by(after(F.split_part(bare_text(), F.lit("FORM"), F.lit(1)), "PAN NO:"), F.when(pan, F.col("line_no"))).alias("PAN_NO"),
    ).select(
        "path", "_block", part(F.transform("_p", lambda p: p["text"]), 0).alias("CUSTOMER_NAME"),
        F.array_join(F.transform(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), lambda p: p["text"]), " ").alias("CUSTOMER_ADDRESS"),
        F.coalesce("DOB", F.lit("")).alias("DOB"), F.coalesce("PAN_NO", F.lit("")).alias("PAN_NO"),
    )
    closes = has_any(raw_line(), ("CUSTOMER TOTAL", "TOTAL INTEREST PAID", "ASSURING YOU OF OUR BEST SERVICES", "REPORT ID"))
    table = between(rows.filter(~head | pan), raw_line().contains("ACCOUNT NO.   DEP.DATE    MAT.DATE"), closes)
    subject = F.when(F.col("_subject_of").eqNullSafe(block), F.col("SUBJECT")).otherwise("")
    table = table.filter((bare_text() != "") & ~made_of(bare_text(), "=-")).withColumn("SUBJECT", subject)
    names = (
        "ACCOUNT_NO DEP_DATE MAT_DATE PRINCIPAL_AMT RATE INT_PAID TAX_DEDUCTED INT_PROJECTED ACC_STS DESCRIPT TDS_APPLICABLE"
    ).split()
    table = gaps(table, names, at_least=11, keep=["BRANCH_CODE", "BRANCH_NAME", "SUBJECT", "_block"])
    table = table.filter(digits_only(F.col("ACCOUNT_NO")))
    blank = {"CUSTOMER_NAME": "", "CUSTOMER_ADDRESS": "", "DOB": "", "PAN_NO": ""}
    return table.join(heads, ["path", "_block"], "left").fillna(blank).drop("_block")


def overdue_notices(lines: DataFrame) -> DataFrame:
    """The block under "To," up to the next blank line holds name and customer number."""
    rows = lines.withColumn("text", strip(raw_line()))
    rows = carried(rows, {
        "BRANCH_CODE": F.when(raw_line().contains("RACPC/ BR.NO"), last_piece(raw_line())),
        "BRANCH_NAME": F.when(raw_line().contains("RACPC/ BR.NAME"), last_piece(raw_line())),
    })
    opens = bare_text() == "To,"
    rows = ordered.carry_forward(rows, {"_letter": F.when(opens, F.col("line_no"))})
    filled = ~opens & (bare_text() != "") & F.col("_letter").isNotNull()
    begins = rows.filter(filled).groupBy("path", "_letter").agg(F.min("line_no").alias("_begin"))
    rows = rows.join(begins, ["path", "_letter"], "left")
    ends = rows.filter((bare_text() == "") & (F.col("line_no") > F.col("_begin"))).groupBy("path", "_letter").agg(
        F.min("line_no").alias("_end"))
    rows = rows.join(ends, ["path", "_letter"], "left")
    in_address = filled & F.col("_letter").isNotNull() & (
        F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    number = bare_text().rlike("^[0-9]{10,}$")
    people = rows.filter(in_address & F.col("_end").isNotNull()).groupBy("path", "_letter").agg(
        F.min_by(bare_text(), "line_no").alias("CUSTOMER_NAME"),
        F.coalesce(F.min_by(bare_text(), F.when(number, F.col("line_no"))), F.lit("")).alias("CIF_NO"),
    )
    closes = has_any(raw_line(), ("Your early action will be highly appreciated", "Yours faithfully"))
    table = between(rows.filter(~in_address), raw_line().contains("Sr.       Account No.      Drawing Power"), closes)
    table = table.filter((bare_text() != "") & ~made_of(bare_text(), "- ") & ~(bare_text().contains("No.") & bare_text().contains("(Rs.)")))
    table = gaps(table, "SR_NO ACCOUNT_NO DRAWING_POWER OUTSTANDINGS IRREGULAR_BY".split(), at_least=5,
                 keep=["BRANCH_CODE", "BRANCH_NAME", "_letter"]).filter(digits_only(F.col("SR_NO")))
    table = table.join(people, ["path", "_letter"], "left").fillna({"CUSTOMER_NAME": "", "CIF_NO": ""})
    return table.drop("_letter").withColumn("REPORT_ID", F.lit("OVERDUE_NOTICE"))


def sanction_letter(lines: DataFrame) -> DataFrame:
    def starts(key):
        return bare_text().startswith(key), after(bare_text(), key)

    def numbered(key):
        return bare_text().contains(key), last_piece(bare_text())

    rows = letter({
        "BRANCH_CODE_NAME": starts("BRANCH:"), "LETTER_DATE": starts("DATE:"), "CUSTOMER_NAME": starts("Customer Name"),
        "CUSTOMER_ADDRESS": starts("Address"), "CUSTOMER_NUMBER": numbered("1. Customer Number"),
        "ACCOUNT_NUMBER": numbered("2. Account Number"), "PRODUCT": numbered("4. Product"),
        "PURPOSE_OF_LOAN": numbered("5. Purpose of the Loan"), "AMOUNT_APPLIED": numbered("6. Amount Applied"),
        "AMOUNT_APPROVED": numbered("7. Amount Approved"), "DATE_OF_SANCTION": numbered("8. Date of Sanction"),
        "LOAN_TERM_MONTHS": numbered("9. Loan Term"), "RATE_OF_INTEREST": numbered("10. Rate of Interest"),
    }, lines)
    rows = rows.filter("concat(CUSTOMER_NUMBER, ACCOUNT_NUMBER, AMOUNT_APPROVED) <> ''")
    return rows.withColumn("REPORT_ID", F.lit("LOANS_SANCTION_LETTER"))


# ---------------------------------------------------------------- shadow files

_DEP_SHADOW = spans(
    "INSTNO:0-3 ACCNO:3-20 BRNO:20-25 CIFNO:25-42 NAME:42-102 OPNDATE:102-110 CURRENCY:110-113 STATUS:113-115 "
    "STPCHQIND:115-116 CURRBAL:116-134 AVLBAL:134-152 ODLIMIT:152-170 UNCLRAMT:170-188 FROZAMT:188-206 "
    "DRAWINGAMT:206-224 ACCTYPE:224-228 INTCAT:228-232 ACCCODE:232-233 MTDATE:233-241 INTRATE:241-248 SECIND:248-249 "
    "SEGCODE:249-253 ACTCLOSEDT:253-261 SANCDATE:261-269 POSREST:269-270 HOLD:270-271 STOP:271-272 EXTNCTRID:272-277 "
    "NEWIRAC:277-279 OLDIRAC:279-281 DEPPRD:281-289 REPACCCODE:289-290 A1:290-308 DATE:308-318 A2:318-336 "
    "INTAVAIL:336-354 A4:354-372 A5:372-390 A6:390-391 A7:391-401 A8:401-419 A9:419-424 MOP1:424-444 NAME_1:444-504 "
    "N_1:504-505 N_2:505-506 SCHEMEDESC:506-546 BRANCH:546-551 CURR:551-554 UNKNOWN:554-558 UNKNOWN1:558-564 "
    "UNKNOWN2:564-571 INTPD:571-589 INTCR:589-607 UNKNOWN_ADDR:607-608 ADDRESS1:608-648 ADDRESS2:648-688 "
    "ADDRESS3:688-728 ADDRESS4:728-768 PINCODE:768-774 MOB_NO:774-786"
)
_LOAN_SHADOW = spans(
    "INSTNO:0-3 ACCNO:3-20 BRNO:20-25 CIFNO:25-42 NAME:42-102 OPNDATE:102-110 CURRENCY:110-113 STATUS:113-115 "
    "STPCHQIND:115-116 CURRBAL:116-134 AVLBAL:134-152 UNCLRAMT:152-170 LOANARREAR:170-188 NEXTREPDT:188-196 "
    "ACCTYPE:196-200 INTCAT:200-204 ACCCODE:204-205 MTDATE:205-213 INTRATE:213-220 SECIND:220-221 SEGCODE:221-225 "
    "ACTCLOSEDT:225-233 SANCDATE:233-241 POSREST:241-242 HOLD:242-243 STOP:243-244 EXTNCTRID:244-249 NEWIRAC:249-251 "
    "OLDIRAC:251-253 DEPPRD:253-257 EMIDUE:257-261 EMIPAID:261-265 EMIOVERDUE:265-269 ODLIMIT:269-287 DATE:287-297 "
    "CODE:297-302 NAME1:302-362 REPACCCODE:362-363 SCHEMEDESC:363-388 ADDRESS1:388-428 ADDRESS2:428-468 "
    "ADDRESS3:468-508 ADDRESS4:508-548 PINCODE:548-554"
)


def deposit_shadow(lines: DataFrame) -> DataFrame:
    return sliced(body(lines), _DEP_SHADOW)


def loan_shadow(lines: DataFrame) -> DataFrame:
    return sliced(body(lines), _LOAN_SHADOW)


LAYOUTS = {
    "ADVICEFORTD": maturity_advice,
    "AGEWISE_REPORT_OF_SYS_SUSP_GEND7053": suspense_ageing,
    "ARREARS_BREAK_UP_LOND2498": arrears_break_up,
    "AUDIT_BGL_ACCOUNTS_AGE_WISE_BREAK_UP_GEND0805": audit_bgl_ageing,
    "BAL_IN_GL_ACC_GLCC_WISE_DET": gl_detail,
    "BAL_IN_LOAN_ACC_GLCC_WISE_DET": loan_gl_detail,
    "BAL_IN_LOAN_ACC_GLCC_WISE_SUM": loan_gl_summary,
    "BGL_TXN_ENQUIRY_GEND0600": bgl_enquiry,
    "CC_OD_BALANCE_FILE_DEPD0580": cc_od_balance,
    "CHEQUE_BOOK_ISSUE_ORDER_CASD0198": cheque_book_orders,
    "COLL_MATURED_SEC_LOND2444": matured_securities,
    "CREDIT_BALANCE_IN_EXPENSE_ACCOUNT_GEND7042": expense_credit,
    "CUSTOMER_MEMBER_REPORT": customer_members,
    "DAILY_BRANCH_OPEND_ACCOUNTS_NONWKIT": branch_opened_accounts,
    "DAILY_PRODUCTWISE_REPORT_LOAN_DEP_CLEARING_GNBD7376": daily_productwise,
    "DEBIT_TRANSACTIONS_ON_INCOME_ACCT_GEND7045": income_debit_txns,
    "DEPOSITS_BALANCE_FILE_DEPD0586": deposits_balance,
    "DEP_SHADOW_FILE": deposit_shadow,
    "DETAILS_OF_INVENTORY_RECD_CFPD0305": inventory_received,
    "DRAWING_POWER_LOND2388": drawing_power,
    "EXCEPTION_REPORT_DEPD0670": limit_breaches,
    "EXCEPTION_REPORT_FOR_INTEREST_RATES_VARIATION_DEPD0650": rate_variation,
    "GEND1012_PRT": journal_check,
    "GEND1012_PRT2": journal_amounts,
    "GLCC_WISE_BAL_REP": glcc_balances,
    "GLCC_WISE_SUM_REP": glcc_summary,
    "GL_DAYBOOK_GEND0807": gl_daybook,
    "GL_OUTSTANDING_ACCNTS_GENM0808": gl_outstanding,
    "HOMEBRANCHUSERS_CFPD0300": home_branch_users,
    "ID_LEAST_TRANSACTION_LOND2482": least_active_ids,
    "ID_USERS_LOGGED_NO_TRANSACTIONS_LOND2482": idle_users,
    "ID_USERS_TERMINALS_NOT_LOGGED_LOND2482": idle_users,
    "INTERBRANCH_TRANSACTIONS_BY_US_CIFD0528": interbranch_by_us,
    "INTERBRANCH_TRANSACTIONS_CIFD0528": interbranch,
    "INTERESTRATECHANGELOANS_CFPD0337": rate_changes,
    "INT_PAID_PROJ": interest_projection,
    "INVENTORY_REPORT": stationery,
    "IRREGULAR_EXCESS_DRAW_LOND2397CPC": excess_draw,
    "LIEN_MARKED_REMOVAL_DEPD0702": lien_operations,
    "LISTOF_NPA_ACCOUNTS_LOND2572": npa_accounts,
    "LOANSBALANCEFILE_LOND2390": loans_balance,
    "LOANS_SANCTION_LETTER": sanction_letter,
    "LOAN_IRREGULAR_REPORT": loan_irregular,
    "LOAN_SHADOW_FILE": loan_shadow,
    "MATURITY_LIST_DEPD0623": maturity_list,
    "NON_HOME_BRANCH_CIFD0363": non_home_branch,
    "NPA_STMT": npa_statement,
    "OVERDUE_NOTICE_LOND2384": overdue_notices,
    "PROBABLE_NPA_REPORT_LOND2463": probable_npa,
    "REPORT_HIGH_VALUE_TRANSACTIONS": high_value_transactions,
    "SUPPLIMENTARY_REPORT_GEND7484": supplementary,
    "SYSTEM_GENERATED_TRANSACTIONS_LOND2543": system_generated,
    "SYSTEM_TRANSACTIONS_REPORT_DEPD0903": system_transactions,
    "VOUCHER_VARIFICATION_REPORT_CFPD0331": vouchers_0331,
    "VOUCHER_VARIFICATION_REPORT_CFPD0344": vouchers_0344,
}

# Columns that differ from file to file come in long form (path, row_no, column_name, value).
INFERRED = {
    "ACCOUNT_ALTERATION": inferred.grid_columns,
    "ACCOUNT_CLOSED_REPORT": inferred.blank_columns,
    "ACCOUNT_OPENED_REPORT": inferred.blank_columns,
    "DEBIT_BALANCE_IN_INCOME_ACCOUNT_GEND7041": inferred.ruled_columns,
    "LIST_OF_NPA_ACCOUNTS": inferred.dash_columns,
    "LOANS_SANCTION_LETTER_FOR_AC402000294534": inferred.ruled_columns,
    "PIPE_DELIMITED": inferred.pipe_columns,
    "REPORT_MATURING_SECURITIES_LOND2443": inferred.ruled_columns,
    "RUPEE_DRAWING_LIST_CFPD0388": inferred.ruled_columns,
    "SUPPLIMENTARY_CONTROL_GEND7516": inferred.piped_ruled_columns,
    "TRANSFER_SUPPLEMENTARY_GEND7516": inferred.piped_ruled_columns,
}
