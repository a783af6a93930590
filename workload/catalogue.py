"""Every layout of the catalogue over a whole table: one report a branch with a record for each customer, read back and compared.

A line is a text, or a list of (column, text); in both ``<A>`` (account), ``<K>`` (running number), ``<N>`` (name), ``<M>`` (amount) and
``<D>`` (date) stand for the customer's values. What a layout should find is stated with the same marks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerlake.sources import inferred, layouts
from ledgerlake.sources.ingest import parse

from .registry import query
from .standins import code, money

MARKS = {
    "A": code("c_custkey", 12), "K": "cast(c_custkey as string)", "N": "'MR ' || c_mktsegment", "M": money("abs(c_acctbal) + 1"),
    "D": f"{code('1 + c_custkey % 28', 2)} || '/04/2025'",
}
RULE = "-" * 40
FOOT = 900_000_000


def _text(template: str) -> str:
    """The template as SQL text."""
    parts = re.split(r"<([AKNMD])>", template)
    cells = [MARKS[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if i % 2 or p]
    return "(" + (" || ".join(cells) or "''") + ")"


def _line(line: str | list) -> str:
    if isinstance(line, str):
        return _text(line)
    starts = [start for start, _ in line] + [None]
    cells = [f"repeat(' ', {starts[0]})"] if starts[0] else []
    for (start, text), after in zip(line, starts[1:]):
        cells.append(f"rpad({_text(text)}, {after - start}, ' ')" if after is not None else _text(text))
    return " || ".join(cells)


def report(name: str, head: list, record: list, foot: list) -> str:
    path = f"'{name}/' || {code('n_nationkey')} || '.txt'"
    parts = [f"select {path} as path, cast({at + i} as bigint) as line_no, {_line(line)} as line from {{nation}}" for at, lines in ((0, head), (FOOT, foot)) for i, line in enumerate(lines)]
    own = path.replace("n_nationkey", "c_nationkey")
    parts += [f"select {own} as path, cast({1000 + i} + c_custkey * 20 as bigint) as line_no, {_line(line)} as line from {{customer}}" for i, line in enumerate(record)]
    return " union all ".join(parts)


def _limits(found: dict, values: dict[str, str]) -> tuple[list, dict[str, str]]:
    """A line with something in every column of a fixed-width layout."""
    cells = {n: values.get(n, f"{n[:2]}{i}"[: (e or 999) - s]) for i, (n, (s, e)) in enumerate(found.items())}
    return [(found[n][0], v) for n, v in cells.items()], cells


def _fixed(found: dict, head: list, values: dict[str, str], foot: list, more: dict[str, str] | None = None):
    line, cells = _limits(found, values)
    return head, [line], foot, cells | (more or {})


_HOME = "BRANCH NO :     2   BRANCH NAME : RAIL HEAD"
CATALOGUE = {
    "PROBABLE_NPA_REPORT_LOND2463": _fixed(layouts._LOND2463, [RULE, "HEADER", RULE], {"SR_NO": "<K>", "ACCOUNT_NO": "<A>"}, ["NIL REPORT here", "short"]),
    "INTERBRANCH_TRANSACTIONS_CIFD0528": _fixed(layouts._BRANCH_TXN, [RULE, "SR.NO  CUSTOMER NAME", RULE], {"SR_NO": "<K>"}, ["  TOTAL: 5", "No BGL Transactions"]),
    "DEP_SHADOW_FILE": _fixed(layouts._DEP_SHADOW, [], {}, [""]),
    "LOAN_SHADOW_FILE": _fixed(layouts._LOAN_SHADOW, [], {}, ["RUN DATE x"]),
    "NON_HOME_BRANCH_CIFD0363": _fixed(layouts._NON_HOME, [_HOME + "     PAGE NO : 1", _HOME], {"SR_NO": "<K>", "ACCOUNT_NUMBER": "<A>"}, ["TOTAL: 1"], {"BRANCH_CODE": "00002", "BRANCH_NAME": "RAIL HEAD"}),
    "GLCC_WISE_SUM_REP": ([RULE, "CLASS CODE"], [[(0, "00001INR<K>"), (39, "6"), (51, "<N>"), (91, "<M>"), (172, "5.00")]], ["TOTAL"],
                          {"GL_CLASS_CODE": "00001INR<K>", "ACT_TOTAL": "6", "NAME": "<N>", "TOTAL_AMOUNT": "<M>", "TOTAL_COLLECTION_AMT": "5.00"}),
    "GLCC_WISE_BAL_REP": ([RULE, "GL CLASS CODE 00001INR1 Staff"], [[(0, "<K>"), (10, "<A>"), (28, "402"), (43, "<N>"), (74, "<M>"), (164, "3.00")]], ["TOTAL"],
                          {"SLNO": "<K>", "CUSTOMER": "<A>", "ACCOUNT": "402", "DR_BALANCE": "<M>", "COLL_AMT": "3.00", "GL_CLASS_CODE": "00001INR1"}),
    "BAL_IN_GL_ACC_GLCC_WISE_DET": (["GL CLASS CODE 0001 X"], [[(0, "<K>"), (8, "<A>"), (27, "<N>"), (61, "INR"), (71, "5.00"), (93, "<M>")]], ["===> TOTAL"],
                                    {"SLNO": "<K>", "LEDGER_NAME": "<N>", "CURRENCY": "INR", "CR_BALANCE": "<M>", "GL_CLASS_CODE": "0001 X"}),
    "BAL_IN_LOAN_ACC_GLCC_WISE_SUM": ([[(1, "GL CLASS"), (40, "ACT TOTAL")]], [[(2, "00001INR<K>"), (45, "6"), (51, "<N>    <M>"), (116, "7.00")]], [],
                                      {"GL_CLASS_CODE": "00001INR<K>", "ACT_TOTAL": "6", "NAME": "<N>", "TOTAL_AMOUNT": "<M>", "TOTAL_INTEREST": "7.00"}),
    "BGL_TXN_ENQUIRY_GEND0600": ([], [[(0, "00001"), (5, "00002"), (20, "U<K>"), (67, "<M>"), (190, "REF")]], ["no row"], {"S1_NO": "00001", "BRANCH": "00002", "USER": "U<K>", "AMOUNT_DR": "<M>", "REFERENCE_NO": "REF"}),
    "CREDIT_BALANCE_IN_EXPENSE_ACCOUNT_GEND7042": ([RULE, "H", RULE], [[(0, "<A>"), (19, "<N>"), (65, "1.00"), (89, "<M>")]], ["TOTAL 5", "NIL REPORT"],
                                                   {"ACCOUNT_NUMBER": "<A>", "DESCRIPTION": "<N>", "TXN_AMOUNT": "1.00", "BALANCE": "<M>"}),
    "DEBIT_TRANSACTIONS_ON_INCOME_ACCT_GEND7045": ([RULE, "H", RULE], [[(0, "<A>"), (19, "<D>"), (33, "<M>"), (49, "<N>"), (95, "M1"), (107, "C1")]], [],
                                                   {"ACCOUNT_NO": "<A>", "DATE": "<D>", "TXN_AMOUNT": "<M>", "DESCRIPTION": "<N>", "MAKER_ID": "M1", "CHECKER_ID": "C1"}),
    "CUSTOMER_MEMBER_REPORT": (["____|____"], [[(0, "<K>"), (7, "<A>"), (26, "<N>"), (88, "M<K>"), (142, "<D>")]], ["|x|"],
                               {"SERIAL_NO": "<K>", "CUSTOMER_NUMBER": "<A>", "NAME_OF_CUSTOMER": "<N>", "MEMBERSHIP_NUMBER": "M<K>", "MEMBERSHIP_DATE": "<D>"}),
    "EXCEPTION_REPORT_FOR_INTEREST_RATES_VARIATION_DEPD0650": ([RULE, "ACCOUNT   CUSTOMER NAME"], [[(5, "<A>"), (20, "<N>"), (70, "<M>"), (85, "11"), (92, "2"), (100, "7.00"), (112, "8.50")]], [],
                                                               {"ACCOUNT_NUMBER": "<A>", "CUSTOMER_NAME": "<N>", "SANCTION_AMOUNT": "<M>", "PRODUCT_INT_RATE": "7.00", "EFFECTIVE_INT_RATE": "8.50"}),
    "ID_LEAST_TRANSACTION_LOND2482": ([RULE, "SL-NO", RULE], [[(0, "<K>"), (15, "9<K>"), (30, "2"), (50, "3"), (61, "4")]], ["TOTAL"],
                                      {"SL_NO": "<K>", "ID": "9<K>", "NO_OF_TXNS_DEBIT": "2", "NO_OF_TXNS_CREDIT": "3", "MEMO_HITS": "4"}),
    "GEND1012_PRT": ([RULE, "H", RULE], [[(0, "<K>"), (17, "CASH"), (48, "<A>"), (95, "<M>"), (110, "6.00")]], ["*Note: end", [(0, "88"), (95, "9.00")]],
                     {"JRNL_NO": "<K>", "DESCRIPTION": "CASH", "ACCOUNT_NO": "<A>", "AMOUNT": "<M>", "AMOUNT_IN_TECH_CONT": "6.00"}),
    "GEND1012_PRT2": ([RULE, "H", RULE], [[(0, "<K>"), (28, "<M>")]], ["Please confirm", [(0, "88"), (28, "9.00")]], {"JOURNAL_NO": "<K>", "LCY_AMOUNT": "<M>"}),
    "COLL_MATURED_SEC_LOND2444": ([], [[(0, "<K>"), (7, "<A>"), (23, "<N>"), (53, "LN"), (59, "777"), (75, "C1"), (123, "<D>")]], ["123456 no"],
                                  {"SR_NO": "<K>", "ACCOUNT_NO": "<A>", "CUSTOMER_NAME": "<N>", "SYSTEM": "LN", "LOAN_ACCNT_NO": "777", "MATURITY_DATE": "<D>"}),
    "SYSTEM_TRANSACTIONS_REPORT_DEPD0903": (["---x"], [[(0, "1"), (4, "11"), (55, "<A>"), (73, "<N>"), (109, "<M>"), (166, "INT")]], ["2 short"],
                                            {"SNO": "1", "ACCOUNT_NUMBER": "<A>", "CUSTOMER_NAME": "<N>", "CREDIT_AMOUNT": "<M>", "TRANSACTION_NARRATION": "INT"}),
    "SYSTEM_GENERATED_TRANSACTIONS_LOND2543": (["PRODUCT DESCRIPTION : HOME LOAN", "===="], [[(0, "<A>"), (21, "<N>"), (60, "INT"), (98, "<D>"), (114, "<M>")]], ["PROD TOTAL 5"],
                                               {"ACCOUNT_NUMBER": "<A>", "CUSTOMER_NAME": "<N>", "TRANSACTION_AMOUNT": "<M>", "PRODUCT_NAME": "HOME LOAN"}),
    "INTERBRANCH_TRANSACTIONS_BY_US_CIFD0528": ([RULE, "H", RULE], ["  any <N> text <K> "], [], {"RAW_LINE": "any <N> text <K>"}),
    "HOMEBRANCHUSERS_CFPD0300": ([RULE, "H", RULE], ["U<K>  <N>  9  1  G  ACTIVE  CLERK  D1"], ["TOTAL  1"], {"USER_ID": "U<K>", "USER_NAME": "<N>", "USER_STATUS": "ACTIVE", "DIVISION": "D1"}),
    "DETAILS_OF_INVENTORY_RECD_CFPD0305": (["DETAILS OF INVENTORY RECEIVED FROM 01/01/2025 TO 31/01/2025", "===="], [[(0, "CHEQUE BOOK <K>"), (31, "<D>"), (43, "sb"), (92, "10"), (104, "20")]], [],
                                           {"INVENTORY_CATEGORY": "CHEQUE BOOK <K>", "DATE_OF_RECEIPT": "<D>", "PREFIX": "sb", "OPENING_BALANCE": "10", "CLOSING_BALANCE": "20", "FROM_DATE": "01/01/2025", "TO_DATE": "31/01/2025"}),
    "CC_OD_BALANCE_FILE_DEPD0580": (["| ACCOUNT NO | x |"], ["|<A>|CC|<N>|9.5|5|6|31/03/2026|<M>-|0|0|00|00|<D>|1|2|OPEN|"], [],
                                    {"ACCOUNT_NUM": "<A>", "RATE": "9.5", "ACCOUNT_BALANCE": "<M>-", "SANCTION_DT": "<D>", "ACCT_MAINTAIN_BRANCH": "2", "STATUS": "OPEN"}),
    "IRREGULAR_EXCESS_DRAW_LOND2397CPC": (["| SL | a |"], ["| <K> | CC | <A> | <N> | 5 | 6 | <M> | 8 | <D> | U1 |"], [],
                                          {"SL_NO": "<K>", "ACCOUNT_NUMBER": "<A>", "LIMIT_AMOUNT": "5", "OUTSTANDING": "<M>", "IRREGULARITY": "8", "AUTHORISING_OFFICIAL_ID": "U1"}),
    "AGEWISE_REPORT_OF_SYS_SUSP_GEND7053": (["| ACCOUNT NO: 98 ACCOUNT NAME: SUSPENSE |", "| CURRENCY: INR |", "| SR. NO. |"], ["| <K> | 0822 | <D> | 8090 | <M> | 287 |"], [],
                                            {"ACCOUNT_NO": "98", "ACCOUNT_NAME": "SUSPENSE", "CURRENCY": "INR", "SR_NO": "<K>", "JOURNAL_NO": "0822", "AMOUNT": "<M>", "AGE_DAYS": "287"}),
    "LISTOF_NPA_ACCOUNTS_LOND2572": (["BRANCH-NO:- 5 BRANCH-NAME:- ARNAS   PAGE-NO: 1", "BRANCH-NO:- 5 BRANCH-NAME:- ARNAS"], ["<K> <A> <N> 10.00 0.00 00 04 31-03-2024 <M>- 1 CCOD 0.00 6101"], [],
                                     {"SR_NO": "<K>", "ACCOUNT_NUMBER": "<A>", "CUSTOMER_NAME": "<N>", "NEW_IRAC": "04", "OUTSTANDING": "<M>-", "SYS1": "CCOD", "PRODUCT": "6101", "BRANCH_CODE": "00005", "BRANCH_NAME": "ARNAS"}),
    "LOANSBALANCEFILE_LOND2390": (["===="], ["<A>  Term Loan  <N>   K  <M> 9.500 1.00 2.00 3.00 01-01-2020 12 10 2 00 00 0.00 A INR 00061"], [],
                                  {"ACCOUNT_NO": "<A>", "ACCOUNT_TYPE": "Term Loan", "CUSTOMER_NAME": "<N> K", "LIMIT": "<M>", "INT_RATE": "9.500", "OUTSTANDING": "2.00", "EMIS_OVERDUE": "2", "CURRENCY": "INR", "ACCT_MTAIN_BRCH": "00061"}),
    "LOAN_IRREGULAR_REPORT": (["===="], ["<K> <A> <N>  6101 1001  HOUSING LOAN  01-01-2020  <M>  6.00  7.00  8.00  9.00 EMI 00 01 31-01-2025"], [],
                              {"SR_NO": "<K>", "ACCOUNT_NO": "<A>", "NAME_OF_BORROWER": "<N>", "TYPE": "6101", "CAT": "1001", "DESCRIPT": "HOUSING LOAN", "APPROVAL_DATE": "01-01-2020", "OUTSTANDING": "<M>", "IRREGULARITY": "7.00",
                               "INSTALMENT": "9.00", "EMI_NONEMI": "EMI", "OLD_BAD_IND": "00", "NEW_BAD_IND": "01", "DATE": "31-01-2025"}),
    "REPORT_HIGH_VALUE_TRANSACTIONS": (["[c"], ["<K> <A> <N> 25-04-2025 <M>- FRM0000 X"], [], {"SR_NO": "<K>", "ACCOUNT_NO": "<A>", "ACCOUNT_NAME": "<N>", "AMOUNT": "<M>-", "NARRATION": "FRM0000 X"}),
    "LIEN_MARKED_REMOVAL_DEPD0702": ([RULE], ["<K> <A>-1 TDR SPECIAL  <M>  COURT ORDER  MARK U1 C1"], [],
                                     {"SR_NO": "<K>", "ACCOUNT_NO": "<A>-1", "TYPE_OF_ACCOUNT": "TDR SPECIAL", "LIEN_AMOUNT": "<M>", "REASON": "COURT ORDER", "MARK_REM": "MARK", "CHK_ID": "C1"}),
    "INTERESTRATECHANGELOANS_CFPD0337": ([], ["<K> <A> <N> 6101 <M> <D> 8.5 9.5"], [], {"SL_NO": "<K>", "ACCOUNT_NO": "<A>", "CUSTOMER_NAME": "<N>", "OLD_INT_RATE": "8.5", "NEW_INT_RATE": "9.5"}),
    "ID_USERS_LOGGED_NO_TRANSACTIONS_LOND2482": (["SL-NO ID"], ["<K> 9<K> <N>"], ["TOTAL: 1"], {"SL_NO": "<K>", "ID": "9<K>", "USER_NAME": "<N>"}),
    "ID_USERS_TERMINALS_NOT_LOGGED_LOND2482": (["SL-NO ID"], ["<K> 9<K> <N>"], ["TOTAL: 1"], {"SL_NO": "<K>", "ID": "9<K>", "USER_NAME": "<N>"}),
    "CHEQUE_BOOK_ISSUE_ORDER_CASD0198": ([RULE], ["<A>-1 <N> 1001 1050 50 01/01/2025 <D> ISSUED 77"], [],
                                         {"ACCOUNT_NUMBER": "<A>-1", "CUSTOMER_NAME": "<N>", "CHEQUE_NO_FROM": "1001", "NO_OF_LEAVES": "50", "ISSUE_DATE": "<D>", "STATUS": "ISSUED", "TELLER_NUMBER": "77"}),
    "DAILY_BRANCH_OPEND_ACCOUNTS_NONWKIT": ([RULE], ["<K> 11-02 <A> <N> <D> 77"], ["PAGE TOTAL 1"], {"S_NO": "<K>", "TYPE_OF_ACCOUNT": "11-02", "ACCOUNT_NUMBER": "<A>", "ACCOUNT_NAME": "<N>", "VERIFYING_OFFICIAL": "77"}),
    "AUDIT_BGL_ACCOUNTS_AGE_WISE_BREAK_UP_GEND0805": ([RULE], ["<A>-1 <N> 00061 REF1 01-01-2025 INW <M> CR OLD ITEM 287"], [],
                                                      {"ACCOUNT_NO": "<A>-1", "BRANCH_NO": "00061", "ENTRY_TYPE": "INW", "AMT_OUTSTD": "<M> CR", "DESC": "OLD ITEM", "AGE_DAYS": "287"}),
    "GL_OUTSTANDING_ACCNTS_GENM0808": ([RULE], ["<A>-1 <N> 01-01-2025 02-01-2025 R1 T1 <M> CR ABC"], ["ACCOUNT TOTAL"],
                                       {"ACCOUNT_NO": "<A>-1", "ACCT_PARTICULARS": "<N>", "REF_NUMBER": "R1", "AMOUNT": "<M> CR", "REM": "ABC"}),
    "GL_DAYBOOK_GEND0807": ([RULE, "ACCOUNT NAME", RULE, [(0, "98765"), (20, "RENT"), (61, "00061")]], [[(68, "<D>"), (80, "CASH"), (125, "<M>"), (170, "U<K>")]], [],
                            {"ACCOUNT_NUMBER": "98765", "ACCOUNT_NAME": "RENT", "HOME_BRANCH": "00061", "VALUE_DATE": "<D>", "TXN_TYPE": "CASH", "DEBIT": "<M>", "USER_ID": "U<K>"}),
    "DRAWING_POWER_LOND2388": ([RULE, "SL NO."], [[(0, "01"), (10, "C<K>"), (23, "<N>"), (105, "B"), (121, "T")], [(2, "1.00"), (29, "402"), (56, "5.00"), (111, "old")], [(2, "2.00"), (29, "<A>"), (76, "<M>")]], [],
                               {"SL_NO": "01", "CUSTOMER_NAME": "<N>", "TOLERANCE_LEVEL": "T", "ACTUAL_VARIANCE": "2.00", "ACCOUNT_NO": "<A>", "DRAWING_POWER": "<M>", "REMARKS": ""}),
    "VOUCHER_VARIFICATION_REPORT_CFPD0331": ([], [[(3, "<A>"), (21, "<N>"), (61, "00061"), (195, "SAVINGS")], [(21, "KUMAR")], [(69, "<D>"), (81, "CASH DEP"), (120, "<M>"), (165, "U1")]], [],
                                             {"ACCOUNT_NUMBER": "<A>", "CUSTOMER_NAME": "<N> KUMAR", "HOME_BRANCH": "00061", "VALUE_DATE": "<D>", "TXN_DESC": "CASH DEP", "DEBIT": "<M>", "USER_ID": "U1", "PRODUCT_DESC": "SAVINGS"}),
    "VOUCHER_VARIFICATION_REPORT_CFPD0344": ([], [[(0, "<A>"), (16, "<N>"), (48, "00061"), (54, "<D>"), (111, "<M>"), (175, "SAVINGS")], [(16, "KUMAR")]], [],
                                             {"ACCOUNT_NUMBER": "<A>", "CUSTOMER_NAME": "<N> KUMAR", "HOME_BRANCH": "00061", "VALUE_DATE": "<D>", "DEBIT": "<M>", "PRODUCT_DESC": "SAVINGS"}),
    "MATURITY_LIST_DEPD0623": (["BRANCH CODE : 00007   BRANCH NAME BANIHAL 1", "PRODUCT TYPE: TDR  ACCOUNT CATEGORY: RETAIL"], [[(0, "<A>"), (17, "INR"), (25, "<N>"), (70, "<M>"), (90, "5.2000"), (101, "<D>")]], [],
                               {"PRODUCT_TYPE": "TDR", "ACCOUNT_CATEGORY": "RETAIL", "ACCOUNT_NUMBER": "<A>", "DEPOSIT_AMOUNT": "<M>", "MATURITY_DATE": "<D>", "BRANCH_CODE": "00007", "BRANCH_NAME": "BANIHAL"}),
    "ADVICEFORTD": (["RAHUL K (601020003187)", "SUBJECT : TERM ACCOUNT(S) MATURING ON 25/05/2025", "ACCOUNT NO.  RECIEPT-NO  CURRENCY", "====="],
                    [[(0, "<A>"), (27, "INR"), (40, "60882.000"), (63, "65610.000"), (74, "<D>"), (86, "00 - OPEN")]], ["ASSURING YOU OF OUR BEST SERVICES", [(0, "402000004073"), (90, "x")]],
                    {"CUSTOMER_NAME": "RAHUL K", "CIF_NO": "601020003187", "SUBJECT_DATE": "25/05/2025", "ACCOUNT_NO": "<A>", "RECEIPT_NO": "", "MAT_VALUE": "65610.000", "ACCOUNT_STATUS": "00 - OPEN"}),
    "INT_PAID_PROJ": ([" BRANCH : (00007) BANIHAL", "DATE : 01/04/2025", "RAHUL K", "WARD 5", "JAMMU", "BIRTH DATE:01-02-1980", "PAN NO: ABC FORM 15G", "SUBJECT : INTEREST PAID", "ACCOUNT NO.   DEP.DATE    MAT.DATE"],
                      ["<A>  01/01/2024  <D>  5.00  7.5  1.00  0.00  2.00  00  TDR  Y"], ["CUSTOMER TOTAL"],
                      {"CUSTOMER_NAME": "RAHUL K", "CUSTOMER_ADDRESS": "WARD 5 JAMMU", "DOB": "01021980", "SUBJECT": "INTEREST PAID", "PAN_NO": "ABC", "ACCOUNT_NO": "<A>", "RATE": "7.5", "DESCRIPT": "TDR", "TDS_APPLICABLE": "Y",
                       "BRANCH_CODE": "00007", "BRANCH_NAME": "BANIHAL"}),
    "OVERDUE_NOTICE_LOND2384": (["RACPC/ BR.NO : 00007", "RACPC/ BR.NAME : BANIHAL", "To,", "", "RAHUL K", "601020003187", "WARD 5", "", "Sr.       Account No.      Drawing Power", "No.   (Rs.)"],
                                ["<K>   <A>   1,87,323.00   <M>   73,400.00"], ["Yours faithfully", "2   809070073989   1.00   2.00   3.00"],
                                {"CUSTOMER_NAME": "RAHUL K", "CIF_NO": "601020003187", "SR_NO": "<K>", "ACCOUNT_NO": "<A>", "OUTSTANDINGS": "<M>", "IRREGULAR_BY": "73,400.00", "BRANCH_CODE": "00007", "BRANCH_NAME": "BANIHAL"}),
    "INVENTORY_REPORT": (["BRANCH NO : 2 |", "INSTRUMENT TYPE: CHEQUE |", "SR. NO.|  PREFIX  |"], ["<K> -CC03 - 1001- 50 - 01 - 01 - 000000000- HELD - INR - 429 |"], [],
                         {"INSTRUMENT_TYPE": "CHEQUE", "BRANCH_CODE": "00002", "SR_NO": "<K>", "PREFIX": "CC03", "LEAVES": "50", "STATUS": "HELD", "TELLER_NO": "429"}),
    "SUPPLIMENTARY_REPORT_GEND7484": (["----", "----"], [[(0, "5.00 6.00 7.00"), (40, "<A>"), (54, "<N>"), (120, "1.00"), (142, "2.00"), (155, "3.00"), (177, "99"), (184, "U1 C1 C2")]], [],
                                      {"CREDIT_CASH": "5.00", "CREDIT_CLEARING": "6.00", "CREDIT_TRANSFER": "7.00", "ACCOUNT_NO": "<A>", "CUSTOMER_NAME": "<N>", "DEBIT_CASH": "1.00", "DEBIT_TRANSFER": "3.00", "CHEQUENO": "99",
                                       "MAKERID": "U1", "CHK1ID": "C1", "CHK2ID": "C2"}),
}

# The inferred layouts by the way in which each finds its columns.
_BLANKS = (["-" * 78, "ACCOUNT NO         DESCRIPTIONS              OUTSTANDING", "-" * 78], [[(0, "<A>"), (19, "<N>"), (45, "<M>")]], [], {"ACCOUNT_NO": "<A>", "DESCRIPTIONS": "<N>", "OUTSTANDING": "<M>"})
_LAST_RULE = (["-" * 78, "ACCOUNT NO         DESCRIPT                  OUTSTANDING", "------------------ ------------------------- ---------------"], [[(0, "<A>"), (19, "<N>"), (45, "<M>")]], [],
              {"ACCOUNTNO": "<A>", "DESCRIPT": "<N>", "OUTSTANDING": "<M>"})
_PIPED_RULE = (["-" * 78, "ACCOUNT NO        |DESCRIPT                 |OUTSTANDING", "-" * 78], [[(0, "<A>"), (18, "|<N>"), (44, "|<M>")]], [], {"ACCOUNTNO": "<A>", "DESCRIPT": "<N>", "OUTSTANDING": "<M>"})
_GROUPS = (["ACCOUNT NO         DESCRIPT                  OUTSTANDING", "------------------ ------------------------- ---------------"], [[(0, "<A>"), (19, "<N>"), (45, "<M>")]], [],
           {"ACCOUNT_NO": "<A>", "DESCRIPT": "<N>", "OUTSTANDING": "<M>"})
_GRID = (["| ACCOUNT      | LOAN                |", "| NO           | KIND     | AMOUNT   |", "|--------------|----------|----------|"], ["| <A> | KIND<K> | <M> |"], [], {})
_CELLS = (["| ACCOUNT NO | KIND | AMOUNT |", "------------"], ["| <A> | <N> | <M> |"], [], {"ACCOUNT_NO": "<A>", "KIND": "<N>", "AMOUNT": "<M>"})
WAYS = {inferred.blank_columns: _BLANKS, inferred.ruled_columns: _LAST_RULE, inferred.piped_ruled_columns: _PIPED_RULE, inferred.dash_columns: _GROUPS, inferred.pipe_columns: _CELLS}
CATALOGUE |= {name: WAYS[way] for name, way in layouts.INFERRED.items() if way in WAYS}


def _register(name: str, head: list, record: list, foot: list, want: dict[str, str]) -> None:
    text = report(name, head, record, foot)
    path = f"'{name}/' || {code('c_nationkey')} || '.txt'"
    values = ", ".join(f"{_text(v)} as \"{c}\"" for c, v in want.items())

    @query(f"cat_{name.lower()}", f"select {path} as path, {values} from customer")
    def run(t):
        rows = parse(t.lines(text), name)
        if "cells" in rows.columns:
            return inferred.pick(rows, list(want)).drop("line_no")
        return rows.select("path", *[F.col(c) for c in want])


for _name, _spec in CATALOGUE.items():
    _register(_name, *_spec)
