"""Every layout on a small hand-made report: generated by position or pattern, then read back."""

import gzip

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import files, inferred, ingest, layouts, metadata, routing, sniff, staging
from ledgerlake.sources.layouts import LAYOUTS


def at(*cells):
    """A line with each text at its column."""
    line = ""
    for start, text in cells:
        line = line.ljust(start) + text
    return line


def rows(df):
    return [{k: v for k, v in r.asDict().items() if k not in ("path", "line_no")} for r in df.orderBy("path", "line_no").collect()]


def by_limits(limits, values=None):
    cells = {n: (values or {}).get(n, f"{n[:2]}{i}"[: (e or 999) - s]) for i, (n, (s, e)) in enumerate(limits.items())}
    return at(*[(limits[n][0], v) for n, v in cells.items()]), cells


D = "-" * 40
FIXED = {
    "PROBABLE_NPA_REPORT_LOND2463": (layouts._LOND2463, [D, "HEADER", D], {"SR_NO": "1", "ACCOUNT_NO": "123"}, ["NIL REPORT here", "short"]),
    "INTERBRANCH_TRANSACTIONS_CIFD0528": (layouts._BRANCH_TXN, [D, "SR.NO  CUSTOMER NAME", D], {"SR_NO": "1"}, ["  TOTAL: 5", "No BGL Transactions"]),
    "DEP_SHADOW_FILE": (layouts._DEP_SHADOW, [], {}, [""]),
    "LOAN_SHADOW_FILE": (layouts._LOAN_SHADOW, [], {}, ["RUN DATE x"]),
    "NON_HOME_BRANCH_CIFD0363": (
        layouts._NON_HOME, ["BRANCH NO :     2   BRANCH NAME : RAIL HEAD     PAGE NO : 1", "BRANCH NO :     2   BRANCH NAME : RAIL HEAD"], {"SR_NO": "1", "ACCOUNT_NUMBER": "77"},
        ["TOTAL: 1"]),
}


@pytest.mark.parametrize("table", FIXED)
def test_fixed_positions(make_lines, table):
    limits, head, values, noise = FIXED[table]
    line, cells = by_limits(limits, values)
    got = rows(LAYOUTS[table](make_lines([*head, line, *noise])))
    assert len(got) == 1
    assert {k: got[0][k] for k in cells} == cells
    if table == "NON_HOME_BRANCH_CIFD0363":
        assert (got[0]["BRANCH_CODE"], got[0]["BRANCH_NAME"]) == ("00002", "RAIL HEAD")


SIMPLE = {
    "GLCC_WISE_SUM_REP": ([D, at((0, "CLASS CODE")), at((0, "00001INR9"), (39, "6"), (51, "Staff Loan"), (91, "1,000.00"), (172, "5.00")), "TOTAL"],
                          {"GL_CLASS_CODE": "00001INR9", "ACT_TOTAL": "6", "NAME": "Staff Loan", "TOTAL_AMOUNT": "1,000.00", "TOTAL_COLLECTION_AMT": "5.00"}),
    "GLCC_WISE_BAL_REP": ([D, "GL CLASS CODE 00001INR1 Staff", at((0, "1"), (10, "601"), (28, "402"), (43, "RAHUL"), (74, "10.00"), (164, "3.00")), "TOTAL"],
                          {"SLNO": "1", "CUSTOMER": "601", "ACCOUNT": "402", "DR_BALANCE": "10.00", "COLL_AMT": "3.00", "GL_CLASS_CODE": "00001INR1"}),
    "BAL_IN_GL_ACC_GLCC_WISE_DET": (["GL CLASS CODE 0001 X", at((0, "1"), (8, "98"), (27, "SUSPENSE"), (61, "INR"), (71, "5.00"), (93, "6.00")), "===> TOTAL"],
                                    {"SLNO": "1", "LEDGER_NAME": "SUSPENSE", "CURRENCY": "INR", "CR_BALANCE": "6.00", "GL_CLASS_CODE": "0001 X"}),
    "BAL_IN_LOAN_ACC_GLCC_WISE_SUM": ([at((1, "GL CLASS"), (40, "ACT TOTAL")), at((2, "00001INR1"), (45, "6"), (51, "Staff Loan    1,000.00"), (116, "7.00"))],
                                      {"GL_CLASS_CODE": "00001INR1", "ACT_TOTAL": "6", "NAME": "Staff Loan", "TOTAL_AMOUNT": "1,000.00", "TOTAL_INTEREST": "7.00"}),
    "BGL_TXN_ENQUIRY_GEND0600": ([at((0, "00001"), (5, "00002"), (20, "U1"), (67, "9.00"), (190, "REF")), "no row"], {"S1_NO": "00001", "BRANCH": "00002", "USER": "U1", "AMOUNT_DR": "9.00", "REFERENCE_NO": "REF"}),
    "CREDIT_BALANCE_IN_EXPENSE_ACCOUNT_GEND7042": ([D, "H", D, at((0, "98765"), (19, "RENT"), (65, "1.00"), (89, "2.00")), "TOTAL 5", "NIL REPORT"],
                                                   {"ACCOUNT_NUMBER": "98765", "DESCRIPTION": "RENT", "TXN_AMOUNT": "1.00", "BALANCE": "2.00"}),
    "DEBIT_TRANSACTIONS_ON_INCOME_ACCT_GEND7045": ([D, "H", D, at((0, "98"), (19, "01/01/2025"), (33, "4.00"), (49, "FEE"), (95, "M1"), (107, "C1"))],
                                                   {"ACCOUNT_NO": "98", "DATE": "01/01/2025", "TXN_AMOUNT": "4.00", "DESCRIPTION": "FEE", "MAKER_ID": "M1", "CHECKER_ID": "C1"}),
    "CUSTOMER_MEMBER_REPORT": (["____|____", at((0, "1"), (7, "601"), (26, "RAHUL"), (88, "M9"), (142, "01/01/2020")), "|x|"],
                               {"SERIAL_NO": "1", "CUSTOMER_NUMBER": "601", "NAME_OF_CUSTOMER": "RAHUL", "MEMBERSHIP_NUMBER": "M9", "MEMBERSHIP_DATE": "01/01/2020"}),
    "EXCEPTION_REPORT_FOR_INTEREST_RATES_VARIATION_DEPD0650": ([D, "ACCOUNT   CUSTOMER NAME", at((5, "4020"), (20, "RAHUL"), (70, "5,000.00"), (85, "11"), (92, "2"), (100, "7.00"), (112, "8.50"))],
                                                               {"ACCOUNT_NUMBER": "4020", "CUSTOMER_NAME": "RAHUL", "SANCTION_AMOUNT": "5,000.00", "PRODUCT_INT_RATE": "7.00", "EFFECTIVE_INT_RATE": "8.50"}),
    "ID_LEAST_TRANSACTION_LOND2482": ([D, "SL-NO", D, at((0, "1"), (15, "900"), (30, "2"), (50, "3"), (61, "4")), "TOTAL"],
                                      {"SL_NO": "1", "ID": "900", "NO_OF_TXNS_DEBIT": "2", "NO_OF_TXNS_CREDIT": "3", "MEMO_HITS": "4"}),
    "GEND1012_PRT": ([D, "H", D, at((0, "77"), (17, "CASH"), (48, "402"), (95, "5.00"), (110, "6.00")), "*Note: end", at((0, "88"), (95, "9.00"))],
                     {"JRNL_NO": "77", "DESCRIPTION": "CASH", "ACCOUNT_NO": "402", "AMOUNT": "5.00", "AMOUNT_IN_TECH_CONT": "6.00"}),
    "GEND1012_PRT2": ([D, "H", D, at((0, "77"), (28, "5.00")), "Please confirm", at((0, "88"), (28, "9.00"))], {"JOURNAL_NO": "77", "LCY_AMOUNT": "5.00"}),
    "COLL_MATURED_SEC_LOND2444": ([at((0, "1"), (7, "402"), (23, "RAHUL"), (53, "LN"), (59, "777"), (75, "C1"), (123, "01/01/2026")), "123456 no"],
                                  {"SR_NO": "1", "ACCOUNT_NO": "402", "CUSTOMER_NAME": "RAHUL", "SYSTEM": "LN", "LOAN_ACCNT_NO": "777", "MATURITY_DATE": "01/01/2026"}),
    "SYSTEM_TRANSACTIONS_REPORT_DEPD0903": (["---x", at((0, "1"), (4, "11"), (55, "402"), (73, "RAHUL"), (109, "5.00"), (166, "INT")), "2 short"],
                                            {"SNO": "1", "ACCOUNT_NUMBER": "402", "CUSTOMER_NAME": "RAHUL", "CREDIT_AMOUNT": "5.00", "TRANSACTION_NARRATION": "INT"}),
    "SYSTEM_GENERATED_TRANSACTIONS_LOND2543": (["PRODUCT DESCRIPTION : HOME LOAN", "====", at((0, "4020001722"), (21, "RAHUL"), (60, "INT"), (98, "01/01/2025"), (114, "5.00")), "PROD TOTAL 5"],
                                               {"ACCOUNT_NUMBER": "4020001722", "CUSTOMER_NAME": "RAHUL", "TRANSACTION_AMOUNT": "5.00", "PRODUCT_NAME": "HOME LOAN"}),
    "INTERBRANCH_TRANSACTIONS_BY_US_CIFD0528": ([D, "H", D, "  any text  "], {"RAW_LINE": "any text"}),
    "HOMEBRANCHUSERS_CFPD0300": ([D, "H", D, "U1  RAHUL K  9  1  G  ACTIVE  CLERK  D1", "TOTAL  1"], {"USER_ID": "U1", "USER_NAME": "RAHUL K", "USER_STATUS": "ACTIVE", "DIVISION": "D1"}),
    "DETAILS_OF_INVENTORY_RECD_CFPD0305": (
        ["DETAILS OF INVENTORY RECEIVED FROM 01/01/2025 TO 31/01/2025", "====", at((0, "CHEQUE BOOK"), (31, "18/02/2025"), (43, "sb"), (92, "10"), (104, "20")), ],
        {"INVENTORY_CATEGORY": "CHEQUE BOOK", "DATE_OF_RECEIPT": "18/02/2025", "PREFIX": "sb", "OPENING_BALANCE": "10", "CLOSING_BALANCE": "20", "FROM_DATE": "01/01/2025", "TO_DATE": "31/01/2025"}),
    "CC_OD_BALANCE_FILE_DEPD0580": (["| ACCOUNT NO | x |", "|402|CC|RAHUL|9.5|5|6|31/03/2026|7-|0|0|00|00|01/01/2020|1|2|OPEN|"],
                                    {"ACCOUNT_NUM": "402", "RATE": "9.5", "ACCOUNT_BALANCE": "7-", "ACCT_MAINTAIN_BRANCH": "2", "STATUS": "OPEN"}),
    "IRREGULAR_EXCESS_DRAW_LOND2397CPC": (["| SL | a |", "| 1 | CC | 402 | RAHUL | 5 | 6 | 7 | 8 | 01/01/2020 | U1 |"],
                                          {"SL_NO": "1", "ACCOUNT_NUMBER": "402", "LIMIT_AMOUNT": "5", "IRREGULARITY": "8", "AUTHORISING_OFFICIAL_ID": "U1"}),
    "AGEWISE_REPORT_OF_SYS_SUSP_GEND7053": (
        ["| ACCOUNT NO: 98 ACCOUNT NAME: SUSPENSE |", "| CURRENCY: INR |", "| SR. NO. |", "| 1 | 0822 | 12/07/2024 | 8090 | 97,885.00 | 287 |"],
        {"ACCOUNT_NO": "98", "ACCOUNT_NAME": "SUSPENSE", "CURRENCY": "INR", "SR_NO": "1", "JOURNAL_NO": "0822", "AMOUNT": "97,885.00", "AGE_DAYS": "287"}),
    "LISTOF_NPA_ACCOUNTS_LOND2572": (
        ["BRANCH-NO:- 5 BRANCH-NAME:- ARNAS   PAGE-NO: 1", "BRANCH-NO:- 5 BRANCH-NAME:- ARNAS", "1 402000294534 Mr. RAHUL 10.00 0.00 00 04 31-03-2024 3,223.80- 1 CCOD 0.00 6101"],
        {"SR_NO": "1", "ACCOUNT_NUMBER": "402000294534", "CUSTOMER_NAME": "Mr. RAHUL", "NEW_IRAC": "04", "OUTSTANDING": "3,223.80-", "SYS1": "CCOD", "PRODUCT": "6101",
         "BRANCH_CODE": "00005", "BRANCH_NAME": "ARNAS", "SYS2": ""}),
    "LOANSBALANCEFILE_LOND2390": (
        ["====", "402000294534  Term Loan  Mr. RAHUL   K  5,000.00 9.500 1.00 2.00 3.00 01-01-2020 12 10 2 00 00 0.00 A INR 00061"],
        {"ACCOUNT_NO": "402000294534", "ACCOUNT_TYPE": "Term Loan", "CUSTOMER_NAME": "Mr. RAHUL K", "LIMIT": "5,000.00", "INT_RATE": "9.500", "OUTSTANDING": "2.00", "EMIS_OVERDUE": "2",
         "CURRENCY": "INR", "ACCT_MTAIN_BRCH": "00061"}),
    "LOAN_IRREGULAR_REPORT": (
        ["====", "1 402000294534 Mr. RAHUL  6101 1001  HOUSING LOAN  01-01-2020  5.00  6.00  7.00  8.00  9.00 EMI 00 01 31-01-2025"],
        {"SR_NO": "1", "ACCOUNT_NO": "402000294534", "NAME_OF_BORROWER": "Mr. RAHUL", "TYPE": "6101", "CAT": "1001", "DESCRIPT": "HOUSING LOAN", "APPROVAL_DATE": "01-01-2020", "OUTSTANDING": "5.00",
         "IRREGULARITY": "7.00", "INSTALMENT": "9.00", "EMI_NONEMI": "EMI", "OLD_BAD_IND": "00", "NEW_BAD_IND": "01", "DATE": "31-01-2025"}),
    "REPORT_HIGH_VALUE_TRANSACTIONS": (["[c", "2 809190002240 Mr. RAHUL 25-04-2025 12,00,000.00- FRM0000 X"],
                                       {"SR_NO": "2", "ACCOUNT_NO": "809190002240", "ACCOUNT_NAME": "Mr. RAHUL", "AMOUNT": "12,00,000.00-", "NARRATION": "FRM0000 X"}),
    "LIEN_MARKED_REMOVAL_DEPD0702": ([D, "1 402-1 TDR SPECIAL  5,000.00  COURT ORDER  MARK U1 C1"],
                                     {"SR_NO": "1", "ACCOUNT_NO": "402-1", "TYPE_OF_ACCOUNT": "TDR SPECIAL", "LIEN_AMOUNT": "5,000.00", "REASON": "COURT ORDER", "MARK_REM": "MARK", "CHK_ID": "C1"}),
    "INTERESTRATECHANGELOANS_CFPD0337": (["1 402000294534 RAHUL K 6101 5,000.00 01/01/2025 8.5 9.5"],
                                         {"SL_NO": "1", "ACCOUNT_NO": "402000294534", "CUSTOMER_NAME": "RAHUL K", "OLD_INT_RATE": "8.5", "NEW_INT_RATE": "9.5"}),
    "ID_USERS_LOGGED_NO_TRANSACTIONS_LOND2482": (["SL-NO ID", "1 900 RAHUL K", "TOTAL: 1"], {"SL_NO": "1", "ID": "900", "USER_NAME": "RAHUL K"}),
    "CHEQUE_BOOK_ISSUE_ORDER_CASD0198": ([D, "402-1 RAHUL K 1001 1050 50 01/01/2025 02/01/2025 ISSUED 77"],
                                         {"ACCOUNT_NUMBER": "402-1", "CUSTOMER_NAME": "RAHUL K", "CHEQUE_NO_FROM": "1001", "NO_OF_LEAVES": "50", "ISSUE_DATE": "02/01/2025", "STATUS": "ISSUED", "TELLER_NUMBER": "77"}),
    "DAILY_BRANCH_OPEND_ACCOUNTS_NONWKIT": ([D, "1 11-02 402000 RAHUL K 01/01/2025 77", "PAGE TOTAL 1"],
                                            {"S_NO": "1", "TYPE_OF_ACCOUNT": "11-02", "ACCOUNT_NUMBER": "402000", "ACCOUNT_NAME": "RAHUL K", "VERIFYING_OFFICIAL": "77"}),
    "AUDIT_BGL_ACCOUNTS_AGE_WISE_BREAK_UP_GEND0805": ([D, "98-1 SUSPENSE A 00061 REF1 01-01-2025 INW 5,000.00 CR OLD ITEM 287"],
                                                      {"ACCOUNT_NO": "98-1", "BRANCH_NO": "00061", "ENTRY_TYPE": "INW", "AMT_OUTSTD": "5,000.00 CR", "DESC": "OLD ITEM", "AGE_DAYS": "287"}),
    "GL_OUTSTANDING_ACCNTS_GENM0808": ([D, "98-1 DRAFTS PAYABLE 01-01-2025 02-01-2025 R1 T1 5,000.00 CR ABC", "ACCOUNT TOTAL"],
                                       {"ACCOUNT_NO": "98-1", "ACCT_PARTICULARS": "DRAFTS PAYABLE", "REF_NUMBER": "R1", "AMOUNT": "5,000.00 CR", "REM": "ABC"}),
    "GL_DAYBOOK_GEND0807": ([D, "ACCOUNT NAME", D, at((0, "98765"), (20, "RENT"), (61, "00061")), at((68, "01/01/2025"), (80, "CASH"), (125, "5.00"), (170, "U1"))],
                            {"ACCOUNT_NUMBER": "98765", "ACCOUNT_NAME": "RENT", "HOME_BRANCH": "00061", "VALUE_DATE": "01/01/2025", "TXN_TYPE": "CASH", "DEBIT": "5.00", "USER_ID": "U1"}),
    "DRAWING_POWER_LOND2388": ([D, "SL NO.", at((0, "01"), (10, "C1"), (23, "RAHUL"), (105, "B"), (121, "T")), at((2, "1.00"), (29, "402"), (56, "5.00"), (111, "old")), at((2, "2.00"), (29, "403"), (76, "9.00"))],
                               {"SL_NO": "01", "CUSTOMER_NAME": "RAHUL", "TOLERANCE_LEVEL": "T", "ACTUAL_VARIANCE": "2.00", "ACCOUNT_NO": "403", "DRAWING_POWER": "9.00", "REMARKS": ""}),
    "VOUCHER_VARIFICATION_REPORT_CFPD0331": (
        [at((3, "4020001722"), (21, "RAHUL"), (61, "00061"), (195, "SAVINGS")), at((21, "KUMAR")), at((69, "01/01/2025"), (81, "CASH DEP"), (120, "5.00"), (165, "U1"))],
        {"ACCOUNT_NUMBER": "4020001722", "CUSTOMER_NAME": "RAHUL KUMAR", "HOME_BRANCH": "00061", "VALUE_DATE": "01/01/2025", "TXN_DESC": "CASH DEP", "DEBIT": "5.00", "USER_ID": "U1", "PRODUCT_DESC": "SAVINGS"}),
    "VOUCHER_VARIFICATION_REPORT_CFPD0344": (
        [at((0, "4020001722"), (16, "RAHUL"), (48, "00061"), (54, "01/01/2025"), (111, "5.00"), (175, "SAVINGS")), at((16, "KUMAR"))],
        {"ACCOUNT_NUMBER": "4020001722", "CUSTOMER_NAME": "RAHUL KUMAR", "HOME_BRANCH": "00061", "VALUE_DATE": "01/01/2025", "DEBIT": "5.00", "PRODUCT_DESC": "SAVINGS"}),
    "MATURITY_LIST_DEPD0623": (
        ["BRANCH CODE : 00007   BRANCH NAME BANIHAL 1", "PRODUCT TYPE: TDR  ACCOUNT CATEGORY: RETAIL", at((0, "809070069144"), (17, "INR"), (25, "SABIYA"), (70, "31,740.00"), (90, "5.2000"), (101, "27/04/2025"))],
        {"PRODUCT_TYPE": "TDR", "ACCOUNT_CATEGORY": "RETAIL", "ACCOUNT_NUMBER": "809070069144", "DEPOSIT_AMOUNT": "31,740.00", "MATURITY_DATE": "27/04/2025", "BRANCH_CODE": "00007", "BRANCH_NAME": "BANIHAL"}),
    "ADVICEFORTD": (
        ["RAHUL K (601020003187)", "SUBJECT : TERM ACCOUNT(S) MATURING ON 25/05/2025", "ACCOUNT NO.  RECIEPT-NO  CURRENCY", "=====",
         at((0, "402000004072"), (27, "INR"), (40, "60882.000"), (63, "65610.000"), (74, "25/05/2025"), (86, "00 - OPEN")), "ASSURING YOU OF OUR BEST SERVICES", at((0, "402000004073"), (90, "x"))],
        {"CUSTOMER_NAME": "RAHUL K", "CIF_NO": "601020003187", "SUBJECT_DATE": "25/05/2025", "ACCOUNT_NO": "402000004072", "RECEIPT_NO": "", "MAT_VALUE": "65610.000", "ACCOUNT_STATUS": "00 - OPEN"}),
    "INT_PAID_PROJ": (
        [" BRANCH : (00007) BANIHAL", "DATE : 01/04/2025", "RAHUL K", "WARD 5", "JAMMU", "BIRTH DATE:01-02-1980", "PAN NO: ABC FORM 15G", "SUBJECT : INTEREST PAID", "ACCOUNT NO.   DEP.DATE    MAT.DATE",
         "402  01/01/2024  01/01/2026  5.00  7.5  1.00  0.00  2.00  00  TDR  Y", "CUSTOMER TOTAL"],
        {"CUSTOMER_NAME": "RAHUL K", "CUSTOMER_ADDRESS": "WARD 5 JAMMU", "DOB": "01021980", "SUBJECT": "INTEREST PAID", "PAN_NO": "ABC", "ACCOUNT_NO": "402", "RATE": "7.5", "DESCRIPT": "TDR",
         "TDS_APPLICABLE": "Y", "BRANCH_CODE": "00007", "BRANCH_NAME": "BANIHAL"}),
    "OVERDUE_NOTICE_LOND2384": (
        ["RACPC/ BR.NO : 00007", "RACPC/ BR.NAME : BANIHAL", "To,", "", "RAHUL K", "601020003187", "WARD 5", "", "Sr.       Account No.      Drawing Power", "No.   (Rs.)",
         "1   809070073988   1,87,323.00   2,60,723.00   73,400.00", "Yours faithfully", "2   809070073989   1.00   2.00   3.00"],
        {"CUSTOMER_NAME": "RAHUL K", "CIF_NO": "601020003187", "SR_NO": "1", "ACCOUNT_NO": "809070073988", "OUTSTANDINGS": "2,60,723.00", "IRREGULAR_BY": "73,400.00", "BRANCH_CODE": "00007", "BRANCH_NAME": "BANIHAL"}),
    "INVENTORY_REPORT": (
        ["BRANCH NO : 2 |", "INSTRUMENT TYPE: CHEQUE |", "SR. NO.|  PREFIX  |", "1 -CC03 - 1001- 50 - 01 - 01 - 000000000- HELD - INR - 429 |"],
        {"INSTRUMENT_TYPE": "CHEQUE", "BRANCH_CODE": "00002", "SR_NO": "1", "PREFIX": "CC03", "LEAVES": "50", "STATUS": "HELD", "TELLER_NO": "429"}),
    "SUPPLIMENTARY_REPORT_GEND7484": (
        ["----", "----", at((0, "5.00 6.00 7.00"), (40, "402000294534"), (54, "RAHUL K"), (120, "1.00"), (142, "2.00"), (155, "3.00"), (177, "99"), (184, "U1 C1 C2"))],
        {"CREDIT_CASH": "5.00", "CREDIT_CLEARING": "6.00", "CREDIT_TRANSFER": "7.00", "ACCOUNT_NO": "402000294534", "CUSTOMER_NAME": "RAHUL K", "DEBIT_CASH": "1.00", "DEBIT_TRANSFER": "3.00",
         "CHEQUENO": "99", "MAKERID": "U1", "CHK1ID": "C1", "CHK2ID": "C2"}),
}


@pytest.mark.parametrize("table", SIMPLE)
def test_sample_report(make_lines, table):
    lines, want = SIMPLE[table]
    got = rows(LAYOUTS[table](make_lines(lines)))
    assert len(got) == 1, got
    assert {k: got[0][k] for k in want} == want


def cells(df):
    return [r.cells for r in df.orderBy("line_no").collect()]


def test_columns_from_dash_groups_and_second_rule(make_lines):
    grouped = ["TITLE", "", "SR    ACCT NO     NAME", "----- ----------- --------", "1     402         RAHUL K", "GRAND TOTAL"]
    assert cells(inferred.dash_columns(make_lines(grouped))) == [{"SR": "1", "ACCT_NO": "402", "NAME": "RAHUL K"}]
    solid = ["-" * 30, "REPORT ID: X", "-" * 30, "SR    ACCT      NAME", "-" * 30, "1     402       RAHUL K"]
    assert cells(inferred.dash_columns(make_lines(solid))) == [{"SR": "1", "ACCT": "402", "NAME": "RAHUL K"}]


def test_columns_from_blank_positions(make_lines):
    lines = ["BANK LTD", "-" * 40, "OPENED DATE   ACCOUNT NUMBER   BALANCE", "-" * 40, "01/01/2025    402000294534     1,000.00", "02/01/2025    402000294535       500.00",
             "OPENED DATE   ACCOUNT NUMBER   BALANCE", "BANK LTD"]
    got = cells(inferred.blank_columns(make_lines(lines)))
    assert [g["ACCOUNT_NUMBER"] for g in got] == ["402000294534", "402000294535"]
    assert [g["BALANCE"] for g in got] == ["1,000.00", "500.00"]
    assert got[0]["OPENED_DATE"] == "01/01/2025"


def test_columns_from_last_near_rule(make_lines):
    lines = ["-" * 30, "TITLE", "-" * 30, "ACCOUNT NO    NAME     AMOUNT", "------------- -------- --------", "402           RAHUL    =>5.00", *["x"] * 20, "-" * 30]
    got = cells(inferred.ruled_columns(make_lines(lines)))
    assert got[0] == {"ACCOUNTNO": "402", "NAME": "RAHUL", "AMOUNT": "5.00"}


def test_columns_under_piped_titles(make_lines):
    lines = ["-" * 30, "CASH  | NO   | NAME", "-" * 30, "5.00  | 402  | RAHUL"]
    assert cells(inferred.piped_ruled_columns(make_lines(lines))) == [{"CASH": "5.00", "NO": "402", "NAME": "RAHUL"}]


def test_grid_and_pipe_headers(make_lines):
    grid = ["| ACCOUNT | INT RATE    |", "| NO      | OLD  | NEW  |", "|---------|------|------|", "| 402     | 7.0  | 7.5  |"]
    assert cells(inferred.grid_columns(make_lines(grid))) == [{"ACCOUNT_NO": "402", "INT_RATE_OLD": "7.0", "INT_RATE_NEW": "7.5"}]
    piped = ["REPORT OF THINGS", "A NO | NAME | NAME", "-----", "1 | x | y", "A NO | NAME |", "2 | z"]
    assert cells(inferred.pipe_columns(make_lines(piped))) == [{"A_NO": "1", "NAME": "x"}, {"A_NO": "2", "NAME": "z"}]


def test_stationery_uses_the_rows_branch(make_lines):
    lines = ["BRANCH NO : 2 |", "SR. NO.|  PREFIX  |", "1 -A - 1- 50 - 01 - 01 - 0- HELD - INR - 4 |", "BRANCH NO : 5 |", "SR. NO.|  PREFIX  |", "2 -A - 1- 50 - 01 - 01 - 0- HELD - INR - 4 |"]
    got = rows(LAYOUTS["INVENTORY_REPORT"](make_lines(lines)))
    assert [(g["BRANCH_CODE"], g["_known_name"]) for g in got] == [("00002", "RAIL HEAD COMPLEX"), ("00005", "ARNAS")]


def test_empty_reports_keep_their_columns(make_lines):
    for table, parse in LAYOUTS.items():
        df = parse(make_lines(["nothing here"]))
        assert "path" in df.columns and len(df.columns) > 2, table


def _report(branch, day, accounts):
    head = [f"REPORT ID : IN0586-01   BRANCH CODE : {branch}   BRANCH NAME : TOWN   PROC DATE : {day}", D, "H", D]
    return head + [at((0, a), (25, "SB"), (55, "RAHUL"), (122, "1.00"), (165, "2.00"), (229, "8.00 OPEN")) for a in accounts]


def test_folder_to_staging(spark, tmp_path):
    base = tmp_path / "in"
    (base / "0425").mkdir(parents=True)
    (base / "old").mkdir()
    text = "\r\n".join(_report("00061", "28/04/2025", ["1", "2"]))
    (base / "0425" / "a.txt").write_text(text)
    (base / "0425" / "b.txt.gz").write_bytes(gzip.compress("\n".join(_report("00007", "28/04/2025", ["3"])).encode()))
    (base / "c.txt.gz").write_text("\n".join(_report("00008", "28/04/2025", ["4", "5"])))
    (base / "d.txt.gz").write_bytes(gzip.compress(b"x" * 10000)[:-20])
    (base / "old" / "e.txt").write_text(text)
    (base / "gend1012.prt2.txt").write_text(text)
    (base / "odd.txt").write_text("no report")
    for _ in range(2):
        done = {files_row.path.rsplit("/", 1)[-1]: (files_row.layout, files_row.error) for files_row in ingest.ingest(
            spark, str(base), str(tmp_path / "stage"), str(tmp_path / "work")).collect()}
    assert done["a.txt"][0] == done["b.txt.gz"][0] == done["c.txt.gz"][0] == "DEPOSITS_BALANCE_FILE_DEPD0586"
    assert done["odd.txt"][0] is None and done["d.txt.gz"][1] is not None
    assert set(done) == {"a.txt", "b.txt.gz", "c.txt.gz", "d.txt.gz", "odd.txt"}
    staged = staging.read_staged(spark, str(tmp_path / "stage"), "DEPOSITS_BALANCE_FILE_DEPD0586")
    got = {(r.BRANCH_CODE, r.ACCOUNT_NUMBER, r.STATUS) for r in staged.collect()}
    assert got == {("00061", "1", "OPEN"), ("00061", "2", "OPEN"), ("00007", "3", "OPEN"), ("00008", "4", "OPEN"), ("00008", "5", "OPEN")}


def test_text_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.text_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.line) for r in got] == [(i, f"line {i}") for i in range(5000)]


def test_classification_and_outcomes(make_lines):
    lines = make_lines({"p.txt": ["a|b|c"] * 4, "w.txt": ["x   y", "longer   line", "zz  q"], "npad0001.txt": ["REPORT ID: NPAD0001"] + ["a,b"] * 9})
    classes = sniff.classify(sniff.delimiters(lines), sniff.structure(lines), metadata.extract_metadata(lines))
    got = {r.path: (r.format, r.status) for r in classes.collect()}
    assert got["p.txt"] == ("DELIMITED", "READY") and got["w.txt"] == ("WHITESPACE", "REVIEW") and got["npad0001.txt"] == ("DELIMITED", "READY")
    routed = routing.route(metadata.extract_metadata(lines))
    counts = lines.groupBy("path").count().selectExpr("path", "count as records", "count as valid_records", "0L as invalid_records")
    summary = sniff.batch_summary(sniff.file_outcomes(classes, routed, counts)).collect()[0]
    assert (summary.total_files, summary.successful, summary.review, summary.total_records) == (3, 1, 2, 10)


def test_files_without_date_or_branch_keep_their_rows(spark):
    rows = [("a", "2025-04-28", "00001", 1), ("b", "2025-04-28", "00001", 2), ("a", "", "", 3), ("b", "", "", 4), ("a", "2025-04-28", "", 5), ("b", "2025-04-28", "", 6), ("c", None, "00001", 7)]
    got = ingest._one_file_per_pair(spark.createDataFrame(rows, "path string, PROC_DATE string, BRANCH_CODE string, n int"))
    assert got.columns == ["path", "PROC_DATE", "BRANCH_CODE", "n", "superseded"] and sorted(r.n for r in got.collect() if not r.superseded) == [2, 3, 4, 5, 6, 7]
    assert [r.n for r in got.collect() if r.superseded] == [1]


@pytest.mark.parametrize("streamed", [False, True])
def test_plain_zipped_mislabelled_cut_and_oversized_files(spark, tmp_path, streamed):
    from ledgerlake.streaming import arrival

    base = tmp_path / "in"
    base.mkdir()
    report = lambda branch, n: "\n".join(_report(branch, "28/04/2025", [str(i) for i in range(1, n + 1)])).encode()
    (base / "plain.txt").write_bytes(report("00001", 400))  # longer than the limit, which is not for plain text
    (base / "zipped.txt.gz").write_bytes(gzip.compress(report("00002", 3)))
    (base / "mislabelled.txt.gz").write_bytes(report("00003", 2))
    (base / "cut.txt.gz").write_bytes(gzip.compress(report("00004", 3))[:-9])
    (base / "oversized.txt.gz").write_bytes(report("00005", 400))
    (base / "empty.txt").write_bytes(b"")
    stage, work, limit = str(tmp_path / "stage"), str(tmp_path / "work"), 20_000
    if streamed:
        arrival.ingest_arrivals(spark, str(base), stage, work, per_batch=2, limit=limit).awaitTermination()
        failed = {r.path.rsplit("/", 1)[-1]: r.error for r in spark.read.parquet(f"{stage}/_quarantine/*").collect()}
    else:
        done = ingest.ingest(spark, str(base), stage, work, limit).collect()
        failed = {r.path.rsplit("/", 1)[-1]: r.error for r in done if r.error}
        assert {r.path.rsplit("/", 1)[-1]: r.staged for r in done if r.layout} == {"plain.txt": 400, "zipped.txt.gz": 3, "mislabelled.txt.gz": 2}
    assert set(failed) == {"cut.txt.gz", "oversized.txt.gz"} and failed["oversized.txt.gz"].startswith("TooLarge")
    staged = staging.read_staged(spark, stage, "DEPOSITS_BALANCE_FILE_DEPD0586")
    assert {r.BRANCH_CODE: r["count"] for r in staged.groupBy("BRANCH_CODE").count().collect()} == {"00001": 400, "00002": 3, "00003": 2}


def test_a_report_without_rows_leaves_its_table(spark, make_lines, tmp_path):
    lines = make_lines({"a.txt": _report("00061", "28/04/2025", [])})
    ingest.ingest_lines(spark, lines, str(tmp_path / "stage"), str(tmp_path / "work"))
    staged = staging.read_staged(spark, str(tmp_path / "stage"), "DEPOSITS_BALANCE_FILE_DEPD0586")
    assert staged.count() == 0 and {"ACCOUNT_NUMBER", "BRANCH_CODE", "PROC_DATE"} <= set(staged.columns)


def test_inferred_columns_need_no_python(spark, make_lines):
    lines = make_lines(["SR    ACCT NO     NAME", "----- ----------- --------", "1     402         RAHUL K"])
    for way in (inferred.dash_columns, inferred.blank_columns, inferred.ruled_columns, inferred.piped_ruled_columns, inferred.grid_columns, inferred.pipe_columns, sniff.structure):
        plan = way(lines)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, way


def test_occupied_positions_of_long_lines(spark, make_lines):
    from ledgerlake.operators import occupancy

    texts = ["a" + " " * 200 + "b", "", "  c", "é\U0001f600 x", "y" * 63 + " " + "z" * 63]
    found = occupancy.occupancy(make_lines(texts).repartition(3), "path")
    want = {i for t in texts for i, ch in enumerate(t) if ch != " "}
    ink = occupancy.ink(found, "path").first().ink
    assert {i for i, ch in enumerate(ink) if ch == "1"} == want and len(ink) % occupancy.BITS == 0
    assert occupancy.inked_count(found, "path").first().inked == len(want)


def test_grid_with_page_header_closing_rule_and_late_gate(make_lines):
    rule = "|---------|------|------|"
    page = [rule, "| ACCOUNT | INT RATE    |", "| NO      | OLD  | NEW  |", rule]
    got = cells(inferred.grid_columns(make_lines([*page, "| 402     | 7.0  | 7.5  |", rule, *page, "| 403     | 7.1  | 7.6  |", rule])))
    assert got == [{"ACCOUNT_NO": "402", "INT_RATE_OLD": "7.0", "INT_RATE_NEW": "7.5"}, {"ACCOUNT_NO": "403", "INT_RATE_OLD": "7.1", "INT_RATE_NEW": "7.6"}]
    late = ["| ACCOUNT | OLD  | NEW  |", *[f"| {400 + i}     | 7.0  | 7.5  |" for i in range(40)], rule]
    got = cells(inferred.grid_columns(make_lines(late)))
    assert [g["ACCOUNT"] for g in got] == [str(400 + i) for i in range(40)]
    # Title cells that do not match the columns: every cell that overlaps one names it.
    odd = ["| A    | B  | C  |", "|-----------|----|", "| 1         | 2  |"]
    assert cells(inferred.grid_columns(make_lines(odd))) == [{"A_B": "1", "C": "2"}]


def test_pages_of_one_order(spark):
    from ledgerlake.operators import explore

    rows = spark.createDataFrame([(str(i % 7), f"n{i}", None if i % 11 == 0 else i) for i in range(300)], "BALANCE string, name string, n int").repartition(4)
    for down in (False, True):
        near = [tuple(r) for k in range(1, 4) for r in explore.page(rows, descending=down, number=k, size=100).collect()]
        far = [tuple(r) for k in range(1, 5) for r in explore.page(rows, descending=down, number=k, size=100, deep=0).collect()]
        assert near == far and len({r[1] for r in far}) == 300 and {r[3] for r in far} == {300}
        walked, last = [], None
        while True:
            page = explore.page_after(rows, last, descending=down, size=90).collect()
            if not page:
                break
            walked, last = walked + [tuple(r) for r in page], page[-1].asDict()
        assert walked == [r[:3] for r in far]


def test_words_are_sought_in_one_look_at_the_text(spark):
    from ledgerlake.functions.text import has_any, made_of

    values = ["", None, "---", "- -", "-=-=", "a-", "--\n", "|+|", "TOTAL:", "a.b", "axb", "[x]", "^", "é--"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    hit, made = has_any(F.upper("v"), ("A.B", "TOTAL:", "[X]", "|+")), made_of(F.upper("v"), "-=")
    got = {r.v: (r.hit, r.made) for r in df.select("v", hit.alias("hit"), made.alias("made")).collect()}
    assert {v for v, (h, _) in got.items() if h} == {"a.b", "TOTAL:", "[x]", "|+|"} and {v for v, (_, m) in got.items() if m} == {"---", "-=-="}
    assert got[None] == (None, None)
    for test in (hit, made):
        assert df.filter(test)._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_blank_positions_read_the_lines_in_few_ways(make_lines):
    lines = ["BANK LTD", "-" * 40, "NO       BALANCE", "-" * 40, "1        5.00", "BANK LTD", "NO       BALANCE", "2        6.00"]
    rows = inferred.blank_columns(make_lines({"a.txt": lines, "b.txt": ["-" * 40, "-" * 40, "1  2"], "c.txt": ["-" * 40, "x"]}))
    assert [(r.path, r.line_no, r.cells) for r in rows.orderBy("path", "line_no").collect()] == [
        ("a.txt", 4, {"NO": "1", "BALANCE": "5.00"}), ("a.txt", 7, {"NO": "2", "BALANCE": "6.00"}), ("b.txt", 2, {"COL": "1  2"})]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("min(line_no") == 0


def test_stored_lines_are_shared_by_many_tasks(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    detail = F.concat(F.rpad(F.sha2(F.col("id").cast("string"), 256), 70, " "), F.lit("5.00"))
    lines = spark.range(120_000).select(F.lit("GL/1.txt").alias("path"), F.col("id").alias("line_no"), F.when(F.col("id") == 0, "REPORT ID : GL1012-01").otherwise(detail).alias("line"))
    ingest.ingest_lines(spark, lines.coalesce(1), f"{tmp_path}/stage", f"{tmp_path}/work")
    files = glob.glob(f"{tmp_path}/work/by_layout/*/*.parquet")
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > len(files)


@pytest.mark.parametrize("way", [inferred.dash_columns, inferred.blank_columns])
def test_data_lines_meet_their_columns_without_a_shuffle(make_lines, way):
    page = ["-" * 40, "NO       BALANCE", "-" * 40] if way is inferred.blank_columns else ["NO       BALANCE", "-------- -------- --------"]
    rows = way(make_lines({f"{x}.txt": [*page, "1        5.00", "2        6.00"] for x in "ab"}))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert rows.count() == 4


@pytest.mark.parametrize("settled", [True, False])
def test_ingest_stores_rows_once_and_superseded_ones_apart(spark, make_lines, tmp_path, settled):
    lines = make_lines({"a.txt": _report("00061", "28/04/2025", ["1", "2"]), "b.txt": _report("00061", "28/04/2025", ["3"]), "c.txt": _report("00007", "28/04/2025", ["4"])})
    lines.write.parquet(f"{tmp_path}/given")
    work, name = tmp_path / "work", "DEPOSITS_BALANCE_FILE_DEPD0586"
    done = ingest.ingest_lines(spark, spark.read.parquet(f"{tmp_path}/given"), f"{tmp_path}/stage", str(work), settled).collect()
    assert {r.path: (r.staged, r.superseded) for r in done} == {"a.txt": (0, 2), "b.txt": (1, 0), "c.txt": (1, 0)}
    assert {r.ACCOUNT_NUMBER for r in staging.read_staged(spark, f"{tmp_path}/stage", name).collect()} == {"3", "4"}
    assert {r.ACCOUNT_NUMBER for r in spark.read.parquet(f"{work}/superseded/{name}").collect()} == {"1", "2"}
    assert {p.name for p in work.iterdir()} == {"files", "by_layout", "attached", "counted", "superseded"} | (set() if settled else {"lines"})
