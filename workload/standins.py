"""Bank staging tables derived from the given tables.

One SQL text per table, valid in Spark and in the checking database alike, so that both sides start from
the same dirty text. ``{name}`` stands for a given table.
"""

from __future__ import annotations

import hashlib
import uuid

from ledgerlake.operators import lineage
from ledgerlake.session import tune

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def dmy(ts: str) -> str:
    return (
        f"lpad(cast(day({ts}) as string), 2, '0') || '/' || lpad(cast(month({ts}) as string), 2, '0') || '/' || "
        f"cast(year({ts}) as string)"
    )


def plain(x: str) -> str:
    return f"cast(cast({x} as decimal(18,2)) as string)"


def money(x: str) -> str:
    """Grouped digits and a trailing minus, as the reports print amounts."""
    s = f"cast(abs(cast({x} as decimal(18,2))) as string)"
    return (
        f"case when length({s}) > 6 then substring({s}, 1, length({s}) - 6) || ',' || substring({s}, length({s}) - 5, 6) "
        f"else {s} end || case when {x} < 0 then '-' else '' end"
    )


def code(x: str, width: int = 5) -> str:
    return f"lpad(cast({x} as string), {width}, '0')"


# Report days by customer segment and by order priority.
SEGMENT_DAY = "case c_mktsegment when 'BUILDING' then '31/03/2025' when 'MACHINERY' then '15/04/2025' else '28/04/2025' end"
PRIORITY_DAY = "case o_orderpriority when '5-LOW' then '15/04/2025' else '28/04/2025' end"
NEWEST = "2025-04-28"

_borrower = "{orders} join {customer} on o_custkey = c_custkey left join {nation} on c_nationkey = n_nationkey"

STANDINS = {
    "network": f"""
        select 'HEAD OFFICE' as HEAD_OFFICE,
          case when n_nationkey = 24 then null when r_name = 'AFRICA' then 'Head Office'
               when r_name = 'ASIA' then 'Rail Head Complex' else r_name end as REGIONAL_OFFICE,
          n_name as BRANCH_NAME, case when n_regionkey = 1 then null else r_name || ' DISTRICT' end as DISTRICT,
          'PLOT ' || cast(n_nationkey as string) as ADDRESS, '0191' as CONTACT_NO, {code('n_nationkey')} as BRANCH_CODE
        from {{nation}} join {{region}} on n_regionkey = r_regionkey""",
    "deposits": f"""
        select '4020-' || {code('c_custkey', 12)} as ACCOUNT_NUMBER,
          case c_mktsegment when 'BUILDING' then 'SB GENERAL' when 'MACHINERY' then 'ca business'
            when 'AUTOMOBILE' then 'STDR TDR' when 'HOUSEHOLD' then 'RD MONTHLY' end as ACCOUNT_TYPE,
          ' ' || c_name as CUSTOMER_NAME, case when c_acctbal >= 0 then {money('c_acctbal')} end as AVAILABLE_BALANCE,
          '0.00' as UNCLEARED_BALANCE, {money('c_acctbal')} as CURRENT_BALANCE, '' as LIMIT, '012' as TERM,
          case c_mktsegment when 'BUILDING' then '8.00 OPEN' when 'MACHINERY' then '5.25'
            when 'AUTOMOBILE' then '6.5 - CLOSED' when 'HOUSEHOLD' then '' end as INT_RATE,
          case c_mktsegment when 'HOUSEHOLD' then '01 - DORMANT' when 'MACHINERY' then 'FROZN' else '' end as STATUS,
          'N' as JOINT_HOLD_FLAG, 'IN0586-01' as REPORT_ID, {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME,
          {SEGMENT_DAY} as PROC_DATE, c_custkey as LOAD_SEQ
        from {{customer}} left join {{nation}} on c_nationkey = n_nationkey""",
    "loans": f"""
        select {code('o_orderkey', 12)} as ACCOUNT_NO, o_orderpriority as ACCOUNT_TYPE, c_name as CUSTOMER_NAME,
          {money('o_totalprice')} as LIMIT, case o_orderstatus when 'P' then '9.50' when 'F' then '11.125' else 'N/A' end as INT_RATE,
          {plain('o_totalprice')} as THEO_BAL, {money('o_totalprice')} as OUTSTANDING, '0.00' as IRREGULARITY,
          replace({dmy('o_orderdate')}, '/', '-') as SANCTION_DATE, '12' as EMIS_DUE,
          case o_orderstatus when 'P' then '' else '7' end as EMIS_PAID, case o_orderstatus when 'O' then 'x' else '5' end as EMIS_OVERDUE,
          case o_orderstatus when 'P' then '00' when 'F' then '01' else '04' end as NEW_IRAC, '00' as OLD_IRAC, '0.00' as ADV_PAID_AMT,
          '1' as ARREAR_COND, 'INR' as CURRENCY, cast(c_nationkey as string) as ACCT_MTAIN_BRCH, 'BR2390-01' as REPORT_ID,
          {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower}""",
    "overdrafts": f"""
        select {code('s_suppkey', 12)} as ACCOUNT_NUM, 'CASH CREDIT' as ACCOUNT_TYP_DESC, s_name as CUSTOMER_NAME, '10.75' as RATE,
          '5,00,000.00' as LIMIT, {money('s_acctbal')} as DRAWING_POWER, '31/03/2026' as LMT_EXPY_DT, {money('s_acctbal')} as ACCOUNT_BALANCE,
          '' as UNCLEARED_BALANCE, '0.00' as IRREGULARITY, '00' as NEW, '00' as OLD, '28-OCT-24' as SANCTION_DT, '2' as ARREAR_COND,
          cast(s_nationkey as string) as ACCT_MAINTAIN_BRANCH, case when s_acctbal < 0 then 'CLSD' else 'OPEN' end as STATUS,
          'IN0580-01' as REPORT_ID, {code('s_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME, '28/04/2025' as PROC_DATE
        from {{supplier}} left join {{nation}} on s_nationkey = n_nationkey""",
    # Seven overlapping risk reports, told apart by order status, priority, price and returned lines.
    "npa_statement": f"""
        select '1' as SR_NO, cast(c_nationkey as string) as BR_NO, 'LOAN' as SYS, {code('o_orderkey', 12)} as ACCT_NO,
          {code('o_custkey', 17)} as CUST_NO, o_orderpriority as PROD_DESCRIPTION, {plain('-o_totalprice')} as BAL_OUTSTAND,
          '0' as OVERDUE_INT, '10.5' as INCA, '0' as UIPY, '-100' as IRR_AMT, '28-OCT-24' as LST_ARR_D, '31-MAR-60' as NPA_DATE,
          case o_orderpriority when '1-URGENT' then '01' when '2-HIGH' then '02' when '3-MEDIUM' then '04' else '00' end as NI,
          '00' as OI, c_name as NAME, 'NPAD0001' as REPORT_ID,
          case when n_regionkey = 2 then null else {code('c_nationkey')} end as BRANCH_CODE, n_name as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower} where o_orderstatus = 'P'""",
    "npa_list": f"""
        select {code('o_orderkey', 12)} as ACCOUNT_NUMBER, c_name as CUSTOMER_NAME, '1,000.00' as INCA, '20.00' as UIPY, '01' as OLD_IRAC,
          'SUB-STD' as NEW_IRAC, replace({dmy('o_orderdate')}, '/', '-') as NPA_DATE, {plain('o_totalprice')} || '-' as OUTSTANDING,
          '3' as ARR_COND, 'BR2572-01' as REPORT_ID, {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower} where o_orderpriority = '1-URGENT'""",
    "probable": f"""
        select {code('o_orderkey', 12)} as ACCOUNT_NO, c_name as ACCOUNT_NAME, 'TERM LOAN' as FACILITY, {plain('o_totalprice')} as LIMIT,
          {money('o_totalprice')} as OUTSTANDING, 'R2' as RISK_GRADE, 'BR2463-01' as REPORT_ID, {code('c_nationkey')} as BRANCH_CODE,
          n_name as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower} where o_orderpriority in ('1-URGENT', '2-HIGH')""",
    "arrears": f"""
        select {code('o_orderkey', 12)} as LOAN_ACCOUNT, {plain('o_totalprice')} as ACCOUNT_BALANCE, l1 as ARREARS_1D_28D, l2 as ARREARS_29D_3M,
          l3 as ARREARS_3M_6M, l4 as ARREARS_6M_1Y, l5 as ARREARS_1Y_3Y, l6 as ARREARS_3Y_5Y, l7 as ARREARS_5Y_7Y, '' as ARREARS_7Y_10Y,
          '0.00' as ARREARS_10Y_15Y, '1.25' as ARREARS_15Y_ABOVE, o_orderpriority as PRODUCT_DESCRIPTION, 'BR2498-01' as REPORT_ID,
          {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower} join (
          select l_orderkey, """ + ", ".join(
            f"cast(sum(case when l_linenumber = {i} then cast(l_extendedprice as decimal(18,2)) end) as string) as l{i}" for i in range(1, 8)
        ) + """ from {lineitem} where l_returnflag = 'R' group by l_orderkey) x on l_orderkey = o_orderkey""",
    "drawing": f"""
        select {code('o_orderkey', 12)} as ACCOUNT_NO, c_name as CUSTOMER_NAME, 'B' as BENCHMARK_LEVEL, '10%' as TOLERANCE_LEVEL,
          {plain('o_totalprice')} as ACTUAL_VARIANCE, {money('o_totalprice')} as OUTSTANDING, {money('o_totalprice')} as DRAWING_POWER,
          '0.00' as IRREGULARITY, 'BR2388-01' as REPORT_ID, {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower} where o_totalprice > 250000""",
    "irregular": f"""
        select {code('o_orderkey', 12)} as ACCOUNT_NO, c_name as NAME_OF_BORROWER, 'HOUSING' as DESCRIPT, {money('o_totalprice')} as OUTSTANDING,
          {plain('o_totalprice')} as IRREGULARITY, '0' as OLD_BAD_IND, 'DOUBTFUL-1' as NEW_BAD_IND, 'BR2490-01' as REPORT_ID,
          {code('c_nationkey')} as BRANCH_CODE, case when n_regionkey = 3 then null else n_name end as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower} where o_orderstatus = 'F'""",
    "excess": f"""
        select {code('o_orderkey', 12)} as ACCOUNT_NUMBER, c_name as NAME_OF_BORROWER, 'CC' as PRODUCT_SUBPRODUCT_TYPE,
          {money('o_totalprice')} as LIMIT_AMOUNT, {money('o_totalprice')} as DRAWING_POWER, {plain('o_totalprice')} as OUTSTANDING,
          '5.00' as IRREGULARITY, 'BR2397-01' as REPORT_ID, {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower}""",
    "gl_totals": f"""
        select '00001INR' || upper(p_brand) || p_type as GL_CLASS_CODE, cast(count(*) as string) as ACT_TOTAL, ' ' || p_type as NAME,
          cast(sum(cast(l_extendedprice as decimal(18,2))) as string) as TOTAL_AMOUNT, '1,250.00' as TOTAL_INTEREST, '' as TOTAL_DR_OD_INT,
          '0.00' as TOTAL_UNCLEARED_AMT, '10.00-' as TOTAL_COLLECTION_AMT, 'GL7043-02' as REPORT_ID, {code('s_nationkey')} as BRANCH_CODE,
          '28/04/2025' as PROC_DATE
        from {{lineitem}} join {{part}} on l_partkey = p_partkey join {{supplier}} on l_suppkey = s_suppkey
        where p_type <> 'ECONOMY' group by p_brand, p_type, s_nationkey, l_returnflag""",
    "gl_balances": f"""
        select '00001INR' || upper(p_brand) || p_type as GL_CLASS_CODE, {plain('l_extendedprice')} as DR_BALANCE,
          case l_returnflag when 'R' then '100.00' else '' end as CR_BALANCE, '1.50' as INT_BALANCE, '0.00' as OD_DR_INT_BAL, '' as UNCLRED_BAL,
          '2.00-' as COLL_AMT, 'GL7043-01' as REPORT_ID, {code('s_nationkey')} as BRANCH_CODE, '28/04/2025' as PROC_DATE
        from {{lineitem}} join {{part}} on l_partkey = p_partkey join {{supplier}} on l_suppkey = s_suppkey""",
    "flows": f"""
        select cast(l_linenumber as string) as S_NO, {code('l_orderkey', 12)} as ACCOUNT_NO,
          case when l_returnflag = 'A' then {money('l_extendedprice')} else '' end as CASH_CREDIT, case when l_returnflag = 'R' then {plain('l_extendedprice')} end as CASH_DEBIT,
          '5.00' as CLEARING_CREDIT, '' as CLEARING_DEBIT, {money('l_extendedprice')} as TRANSFER_CREDIT, {plain('l_quantity')} as TRANSFER_DEBIT,
          {plain('l_extendedprice')} as PRODUCT_TOTAL_CREDIT, 'N/A' as PRODUCT_TOTAL_DEBIT,
          case l_linestatus when 'O' then p_brand else p_type end as PROD_CODE, p_name as PROD_DESC, 'GB7376' as REPORT_ID,
          {code('s_nationkey')} as BRANCH_CODE, '28/04/2025' as PROC_DATE
        from {{lineitem}} join {{part}} on l_partkey = p_partkey join {{supplier}} on l_suppkey = s_suppkey""",
    "breaches": f"""
        select '021051' as TRAN_CODE, {code('l_orderkey', 9)} as JRNL_NO, {code('l_partkey', 11)} as ACCOUNT_NO,
          cast(cast(cast(l_extendedprice as decimal(18,2)) * (l_linenumber * 3) as decimal(18,2)) as string) as AMOUNT, '000220' as SUP_ID, '0000' as SUP_ERR_NO,
          case l_returnflag when 'A' then 'LIMIT' else '' end as ERROR_DESC, {money('l_extendedprice')} as OUTSTANDING, '0.00' as LIMIT_AMOUNT,
          case l_linestatus when 'O' then 'CUSTOMER ' || cast(l_suppkey as string) else '' end as CUSTOMER_NAME, 'IN0670-01' as REPORT_ID,
          {code('s_nationkey')} as BRANCH_CODE, case l_linestatus when 'O' then '28/04/2025' else '15/04/2025' end as PROC_DATE
        from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey""",
    "rates": f"""
        select {code('l_orderkey', 12)} as ACCOUNT_NUMBER, 'NAME' as CUSTOMER_NAME, {money('l_extendedprice')} as SANCTION_AMOUNT, '11' as ACCT_TYPE,
          '01' as SUB_TYPE, cast(cast(l_discount * 100 as decimal(8,2)) as string) as PRODUCT_INT_RATE,
          case l_returnflag when 'A' then '' else cast(cast(l_tax * 100 as decimal(8,2)) as string) end as EFFECTIVE_INT_RATE, 'IN0650-01' as REPORT_ID,
          {code('s_nationkey')} as BRANCH_CODE, case l_linestatus when 'O' then '28/04/2025' else '15/04/2025' end as PROC_DATE
        from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey""",
    "large": f"""
        select {code('o_orderkey', 12)} as ACCOUNT_NO, c_name as ACCOUNT_NAME, replace({dmy('o_orderdate')}, '/', '-') as TRANS_DATE,
          cast(cast(cast(o_totalprice as decimal(18,2)) * 12 as decimal(18,2)) as string) || case o_orderstatus when 'F' then '-' else '' end as AMOUNT,
          o_orderpriority as NARRATION, 'BR2599-01' as REPORT_ID, {code('c_nationkey')} as BRANCH_CODE, {PRIORITY_DAY} as PROC_DATE
        from {_borrower}""",
    "liens": f"""
        select {code('o_orderkey', 12)} as ACCOUNT_NO, 'TDR' as TYPE_OF_ACCOUNT,
          cast(cast(cast(o_totalprice as decimal(18,2)) * 2 as decimal(18,2)) as string) as LIEN_AMOUNT, ' COURT' as REASON,
          case o_orderstatus when 'F' then 'mark' when 'O' then 'REM' else 'MARK/REM' end as MARK_REM, 'U1' as USER_ID, 'C1' as CHK_ID,
          'IN0702-01' as REPORT_ID, {code('c_nationkey')} as BRANCH_CODE, {PRIORITY_DAY} as PROC_DATE
        from {_borrower}""",
    "opened": f"""
        select {dmy('o_orderdate')} as OPENED_DATE, {code('o_orderkey', 12)} as ACCOUNT_NUMBER, ' ' || c_name as ACCOUNT_NAME,
          case o_orderpriority when '1-URGENT' then '6001' when '2-HIGH' then '3001' else '5012 ' end as PRODUCT,
          case o_orderstatus when 'P' then '' else replace({money('o_totalprice')}, '-', '') end as BALANCE, 'ACTOPN-01' as REPORT_ID,
          {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower}""",
    "closed": f"""
        select {dmy('o_orderdate')} as CLOSED_DATE, {code('o_orderkey', 12)} as ACCOUNT_NUMBER, c_name as ACCOUNT_NAME,
          case o_orderpriority when '1-URGENT' then '6001' else '1002' end as PRODUCT, 'ACTCLS-01' as REPORT_ID,
          {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME, {PRIORITY_DAY} as PROC_DATE
        from {_borrower} where o_orderstatus = 'F'""",
    "npa": f"""
        select o_orderpriority as DESCRIPT, {money('o_totalprice')} as OUTSTANDING, {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME,
          {dmy('o_orderdate')} as PROC_DATE
        from {_borrower} where o_orderstatus = 'F'""",
    "loan_detail": f"""
        select {code('o_orderkey', 12)} as ACCOUNT, o_orderpriority as PRODUCT_NAME,
          case when o_orderstatus = 'P' then {money('o_totalprice')} else {plain('o_totalprice')} end as DR_BALANCE, {code('c_nationkey')} as BRANCH_CODE,
          n_name as BRANCH_NAME, {dmy('o_orderdate')} as PROC_DATE
        from {_borrower}""",
    "deposit_series": f"""
        select {code('o_custkey', 12)} as ACCOUNT_NUMBER, {plain('o_totalprice')} as CURRENT_BALANCE, {code('c_nationkey')} as BRANCH_CODE,
          n_name as BRANCH_NAME, {dmy('o_orderdate')} as PROC_DATE, o_orderkey as LOAD_SEQ
        from {_borrower} where o_orderstatus <> 'F'""",
    "loan_totals": f"""
        select '00001INR' || o_orderpriority as GL_CLASS_CODE, '1' as ACT_TOTAL, o_orderpriority as NAME, {money('o_totalprice')} as TOTAL_AMOUNT,
          {code('c_nationkey')} as BRANCH_CODE, n_name as BRANCH_NAME, {dmy('o_orderdate')} as PROC_DATE
        from {_borrower} where o_orderstatus <> 'P'""",
    "gl_detail": f"""
        select p_name as LEDGER_NAME, n_name as BRANCH_NAME, {code('s_nationkey')} as BRANCH_CODE,
          case l_returnflag when 'A' then {plain('l_extendedprice')} else '' end as CR_BALANCE,
          case l_returnflag when 'A' then null else {plain('l_extendedprice')} end as DR_BALANCE
        from {{lineitem}} join {{part}} on l_partkey = p_partkey join {{supplier}} on l_suppkey = s_suppkey
          join {{nation}} on s_nationkey = n_nationkey""",
    "daybook": f"""
        select upper(event_type) || ' TRANSACTION OF DAY' as TXN_TYPE, {money('value')} as DEBIT, '' as CREDIT, cast(user_id as string) as USER_ID,
          {code('user_id % 25')} as BRANCH_CODE, {dmy('ts')} as PROC_DATE
        from {{events}}""",
    "users": f"""
        select ' ' || cast(user_id as string) as original_id, cast(sum(case when event_type = 'view' then 1 else 0 end) as string) as NO_OF_TXNS_DEBIT,
          case when max(case when event_type = 'error' then 1 else 0 end) = 1 then cast(sum(case when event_type = 'click' then 1 else 0 end) as string)
            else '' end as NO_OF_TXNS_CREDIT,
          cast(count(*) as string) as MEMO_HITS, {code('user_id % 25')} as BRANCH_CODE
        from {{events}} group by user_id""",
    "members": f"select cast(c_custkey as string) as CUSTOMER_NUMBER, {code('c_nationkey')} as BRANCH_CODE from {{customer}}",
    "deposit_shadow": f"""
        select {code('c_custkey', 17)} as ACCNO, {code('c_nationkey')} as BRNO,
          case c_mktsegment when 'BUILDING' then '00' when 'MACHINERY' then '01' when 'AUTOMOBILE' then '07' when 'HOUSEHOLD' then '99' end as STATUS,
          {plain('c_acctbal')} as CURRBAL, c_mktsegment as SCHEMEDESC
        from {{customer}}""",
    "loan_shadow": f"""
        select {code('o_orderkey', 17)} as ACCNO, {code('c_nationkey')} as BRNO, case o_orderstatus when 'P' then '00' else '02' end as STATUS,
          {plain('-o_totalprice')} as CURRBAL, case o_orderpriority when '5-LOW' then null else o_orderpriority || ' SCHEME FOR ALL MEMBERS' end as SCHEMEDESC
        from {_borrower}""",
    "bgl_ageing": f"""
        select {code('l_orderkey', 12)} as ACCOUNT_NO, cast(l_linenumber * 30 as string) as AGE_DAYS, {code('s_nationkey')} as BRANCH_CODE,
          {dmy('l_shipdate')} as PROC_DATE
        from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey where l_returnflag = 'R'""",
    "alterations": f"""
        select {code('c_custkey', 12)} as ACCOUNT_NO, c_name as CUSTOMER_NAME, '7.00' as INT_RATE_OLD, '7.50' as INT_RATE_NEW, {SEGMENT_DAY} as PROC_DATE,
          case when c_acctbal < 0 then null else 'BR' || cast(c_nationkey as string) end as BRANCH_NAME, c_mktsegment as ACCT_TYPE_OLD, '' as ACCT_TYPE_NEW
        from {{customer}}""",
    "access": """
        select 'ho_admin' as USER_LOGIN, 'HO' as ACCESS_ROLE, cast(null as string) as BRANCH_CODE, cast(null as string) as REGIONAL_OFFICE_CODE, true as IS_ACTIVE
        union all select 'ro_railhead', 'RO', null, 'RO02', true union all select 'ro_railhead', 'BRANCH', '00003', null, true
        union all select 'branch_parade', 'BRANCH', '00007', null, true union all select 'branch_left', 'BRANCH', '00007', null, false""",
}


#: Stand-ins of staging tables with the names of these (see ``loads``).
FOLDERS: dict[str, str] = {}
#: Where the stand-ins and report lines of (application, data folder, name) are stored.
_STORED: dict[tuple[str, str, str], str] = {}


class Tables:
    """Given tables and stand-ins of one data folder, as DataFrames.

    Stand-ins and report lines are what a bank's night leaves behind: tables and folders that are there before a query starts.
    They are written to the shared folder at their first use and read from then on, in splits of their own size."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self._given = tune(spark), folder, {}

    def given(self, name: str):
        if name not in self._given:
            self._given[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._given[name]

    def sql(self, text: str):
        used = {n: self.given(n) for n in GIVEN if "{" + n + "}" in text}
        return self.spark.sql(text, **used)

    def place(self, name: str, make, path: str | None = None) -> str:
        """The folder that ``make`` has filled, once for each session and data folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            path = path or f"{lineage.shared_folder(self.spark)}/fixtures/{uuid.uuid4().hex}"
            with lineage.freed(self.spark):
                make(path)
            _STORED[key] = path
        return _STORED[key]

    def _laid_out(self, text: str, *by: str):
        """The rows of a text, written as they come where a given table has a split for each task; small ones are dealt out first."""
        tasks, rows = self.spark.sparkContext.defaultParallelism, self.sql(text)
        splits = max((self.given(n).rdd.getNumPartitions() for n in GIVEN if "{" + n + "}" in text), default=0)
        return rows if splits >= tasks else rows.repartition(tasks, *by)

    def stored(self, name: str) -> str:
        """The folder of a stand-in, below ``staging()`` under the name of its staging table."""
        path = f"{self.staging()}/{FOLDERS.get(name, name)}"
        return self.place(name, lambda to: self._laid_out(STANDINS[name]).write.mode("overwrite").parquet(to), path)

    def staging(self) -> str:
        """The folder of all stand-ins that were asked for; each has a folder of its table's name."""
        return self.place("stand-ins", lambda path: None)

    def __call__(self, name: str):
        return self.spark.read.parquet(self.stored(name))

    def lines(self, text: str):
        """The report lines that a query text lays out."""
        name = hashlib.sha256(text.encode()).hexdigest()
        return self.spark.read.parquet(self.place(name, lambda path: self._laid_out(text, "path").write.parquet(path)))


def with_standins(text: str, *names: str) -> str:
    """The same stand-ins as common table expressions in front of a checking query."""
    given = {n: n for n in GIVEN}
    parts = [f"{n} as ({STANDINS[n].format(**given)})" for n in names]
    if text.startswith("with ") and parts:
        parts.append(text[len("with "):])
        return "with " + ", ".join(parts)
    return ("with " + ", ".join(parts) + " " if parts else "") + text
