"""Cleansing functions and label rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import cleanse, labels, numbers
from ledgerlake.functions.register import register

from . import oracle as o
from .registry import query
from .standins import code, dmy, money, plain

RAW_CUSTOMER = (
    f"case c_mktsegment when 'BUILDING' then {code('c_custkey', 13)} when 'MACHINERY' then '  CIF-' || {code('c_custkey')} "
    f"when 'AUTOMOBILE' then '' when 'HOUSEHOLD' then '0000' else null end"
)
RAW_ACCOUNT = f"case o_orderstatus when 'O' then ' 4020-' || {code('o_orderkey', 8)} || ' ' when 'F' then '402 ' || {code('o_orderkey', 9)} else '--' end"
RAW_BRANCH = (
    "case o_orderpriority when '1-URGENT' then cast(o_custkey as string) when '2-HIGH' then ' B-' || cast(o_orderkey as string) || '123456' "
    "when '3-MEDIUM' then ' MAIN ' when '4-NOT SPECIFIED' then '' end"
)
RAW_AMOUNT = (
    f"case l_returnflag when 'A' then {money('l_extendedprice')} || '+' when 'N' then '₹ ' || {money('-l_extendedprice')} "
    f"else case l_linestatus when 'O' then {plain('-l_tax')} else 'N/A' end end"
)
RAW_DATE = (
    f"case o_orderpriority when '1-URGENT' then {dmy('o_orderdate')} when '2-HIGH' then replace({dmy('o_orderdate')}, '/', '-') "
    "when '3-MEDIUM' then cast(day(o_orderdate) as string) || '-FEB-' || lpad(cast(year(o_orderdate) % 100 as string), 2, '0') "
    "when '4-NOT SPECIFIED' then cast(year(o_orderdate) as string) || '-' || lpad(cast(month(o_orderdate) as string), 2, '0') || '-05' else 'bad' end"
)
RAW_CLASS = (
    "case o_orderpriority when '1-URGENT' then '01 - SUB STANDARD' when '2-HIGH' then '04' when '3-MEDIUM' then 'Doubtful-2' "
    "when '4-NOT SPECIFIED' then case o_orderstatus when 'O' then '0' when 'F' then 'SUB_STD' else 'LOSS ASSET' end "
    "else case o_orderstatus when 'O' then ' STANDARD' when 'F' then '' else 'NEW_KIND' end end"
)
RAW_STATUS = (
    "case o_orderpriority when '1-URGENT' then '00 - OPEN' when '2-HIGH' then '00' when '3-MEDIUM' then 'clsd by user' "
    "when '4-NOT SPECIFIED' then case o_orderstatus when 'O' then 'DRMNT' when 'F' then 'FROZN' else 'BLOCKED' end "
    "else case o_orderstatus when 'O' then 'INOPERATIVE' when 'F' then '' else '11 - ODD' end end"
)


def _rule(name: str, key: str, raw: str, table: str, fn, check, kind: str = "{}") -> None:
    text = f"select {key} as id, {raw} as raw from {{{table}}}"

    @query(name, f"select id, raw, {kind.format(check('raw'))} as clean from ({text.format(**{table: table})}) t")
    def run(t):
        return t.sql(text).select("id", "raw", fn("raw").alias("clean"))


_rule("fn_01_customer_id", "c_custkey", RAW_CUSTOMER, "customer", cleanse.customer_id, o.customer_id)
_rule("fn_02_account_no", "o_orderkey", RAW_ACCOUNT, "orders", cleanse.account_no, o.account_no)
_rule("fn_03_branch_code", "o_orderkey", RAW_BRANCH, "orders", cleanse.branch_code, o.branch_code)
_rule("fn_04_amount", "l_orderkey * 10 + l_linenumber", RAW_AMOUNT, "lineitem", cleanse.amount, o.amount, "cast({} as double)")
_rule("fn_05_date", "o_orderkey", RAW_DATE, "orders", cleanse.date, o.day, "cast({} as varchar)")
_rule("fn_06_asset_class", "o_orderkey", RAW_CLASS, "orders", cleanse.asset_class, o.asset_class)
_rule("fn_07_account_status", "o_orderkey", RAW_STATUS, "orders", cleanse.account_status, o.account_status)


@query("fn_08_composite_rate", f"""select ACCOUNT_NUMBER, cast({o.rate('INT_RATE')} as double) as rate,
    {o.rate_status('INT_RATE', 'STATUS')} as status from deposits""", "deposits")
def composite_rate(t):
    return t("deposits").select(
        "ACCOUNT_NUMBER", cleanse.rate("INT_RATE").alias("rate"), cleanse.rate_status("INT_RATE", "STATUS").alias("status"))


@query("fn_09_breach_severity", f"""select JRNL_NO, AMOUNT, case when a >= 1000000 then 'CRITICAL' when a >= 500000 then 'HIGH'
    when a >= 100000 then 'MEDIUM' else 'LOW' end as severity from (select JRNL_NO, AMOUNT, {o.amount('AMOUNT')} as a from breaches) t""", "breaches")
def breach_severity(t):
    return t("breaches").select("JRNL_NO", "AMOUNT", labels.breach_severity(cleanse.amount("AMOUNT")).alias("severity"))


_GAP = f"abs(coalesce({o.plain_rate('EFFECTIVE_INT_RATE')}, 0) - coalesce({o.plain_rate('PRODUCT_INT_RATE')}, 0))"


@query("fn_10_rate_severity", f"""select ACCOUNT_NUMBER, cast({_GAP} as double) as gap, case when {_GAP} >= 2 then 'CRITICAL' when {_GAP} >= 1 then 'HIGH'
    when {_GAP} >= 0.5 then 'MEDIUM' else 'LOW' end as severity from rates""", "rates")
def rate_severity(t):
    gap = labels.rate_gap(cleanse.plain_rate("EFFECTIVE_INT_RATE"), cleanse.plain_rate("PRODUCT_INT_RATE"))
    return t("rates").select("ACCOUNT_NUMBER", gap.alias("gap"), labels.rate_severity(gap).alias("severity"))


@query("fn_11_large_txn_severity", f"""select ACCOUNT_NO, case when abs(coalesce({o.amount('AMOUNT')}, 0)) >= 5000000 then 'CRITICAL'
    when abs(coalesce({o.amount('AMOUNT')}, 0)) >= 1000000 then 'HIGH' else 'MEDIUM' end as severity from large""", "large")
def large_severity(t):
    return t("large").select("ACCOUNT_NO", labels.large_txn_severity(cleanse.amount("AMOUNT")).alias("severity"))


@query("fn_12_lien_severity", f"""select ACCOUNT_NO, case when abs(coalesce({o.amount('LIEN_AMOUNT')}, 0)) >= 500000 then 'HIGH'
    when abs(coalesce({o.amount('LIEN_AMOUNT')}, 0)) >= 100000 then 'MEDIUM' else 'LOW' end as severity from liens""", "liens")
def lien_severity(t):
    return t("liens").select("ACCOUNT_NO", labels.lien_severity(cleanse.amount("LIEN_AMOUNT")).alias("severity"))


@query("fn_14_iso_day", f"select ACCOUNT, {o.iso(o.day('PROC_DATE'))} as day from loan_detail", "loan_detail")
def iso_day(t):
    return t("loan_detail").select("ACCOUNT", cleanse.iso_day("PROC_DATE").alias("day"))


@query("fn_15_screen_number", f"""select ACCOUNT_NUMBER,
    {o.r2("coalesce(abs(try_cast(replace(replace(replace(replace(CURRENT_BALANCE, ',', ''), '₹', ''), '$', ''), ' ', '') as double)), 0)")} as value
    from deposits""", "deposits")
def screen_number(t):
    return t("deposits").select("ACCOUNT_NUMBER", numbers.screen_number("CURRENT_BALANCE").alias("value"))


@query("prj_01_product_category", """select ACCOUNT_NUMBER, case when PRODUCT like '6%' then 'LOAN' else 'DEPOSIT' end as category from opened""", "opened")
def product_category(t):
    return t("opened").select("ACCOUNT_NUMBER", labels.product_category("PRODUCT").alias("category"))


@query("prj_02_lien_action", """select ACCOUNT_NO, case upper(trim(MARK_REM)) when 'MARK' then 'MARK' when 'REM' then 'REMOVE'
    else trim(MARK_REM) end as action from liens""", "liens")
def lien_action(t):
    return t("liens").select("ACCOUNT_NO", labels.lien_action("MARK_REM").alias("action"))


@query("prj_03_deposit_class", """select ACCOUNT_NUMBER,
    coalesce(ACCOUNT_TYPE ilike 'SB%' or ACCOUNT_TYPE ilike 'CA%' or ACCOUNT_TYPE ilike 'CURRENT%', false) as casa,
    coalesce(ACCOUNT_TYPE ilike '%TDR%' or ACCOUNT_TYPE ilike 'RD%' or ACCOUNT_TYPE ilike '%FDR%', false) as term from deposits""", "deposits")
def deposit_class(t):
    no = F.lit(False)
    return t("deposits").select(
        "ACCOUNT_NUMBER", F.coalesce(labels.is_casa("ACCOUNT_TYPE"), no).alias("casa"), F.coalesce(labels.is_term("ACCOUNT_TYPE"), no).alias("term"))


@query("prj_04_status_label", """select STATUS as code, case STATUS when '00' then 'Open' when '01' then 'Dormant' when '02' then 'Unclaimed'
    when '03' then 'Inoperative' when '07' then 'Closed' when '11' then 'Inactive' else 'Others' end as label, count(*) as accounts
    from deposit_shadow group by STATUS""", "deposit_shadow")
def status_label(t):
    return t("deposit_shadow").groupBy(F.col("STATUS").alias("code")).agg(F.count("*").alias("accounts")).withColumn(
        "label", labels.deposit_status("code"))


@query("prj_05_group_label", """select coalesce(REGIONAL_OFFICE, 'Unknown Region') as group_name, count(*) as accounts
    from loan_detail l left join network n on l.BRANCH_CODE = n.BRANCH_CODE group by 1""", "loan_detail network")
def group_label(t):
    from ledgerlake.operators.scope import group_label as label

    return label(t("loan_detail"), "ALL", t("network")).groupBy("group_name").agg(F.count("*").alias("accounts"))


@query("prj_06_display_name", """select ACCOUNT_NO, coalesce(nullif(substring(CUSTOMER_NAME, 1, 15), ''), 'Unknown') as name from breaches""", "breaches")
def display_name(t):
    return t("breaches").select("ACCOUNT_NO", labels.display_name(F.col("CUSTOMER_NAME")).alias("name"))


@query("prj_10_unit_scaling", """select o_orderkey, round(o_totalprice / 1e5, 2) as lakhs, round(o_totalprice / 1e7, 2) as crores from orders""")
def unit_scaling(t):
    price = F.col("o_totalprice")
    return t.given("orders").select("o_orderkey", numbers.lakhs(price).alias("lakhs"), numbers.crores(price).alias("crores"))


_ALL_RULES = [
    ("clean_customer_id", "RAW1", o.customer_id), ("clean_account_no", "RAW2", o.account_no), ("clean_branch_code", "RAW3", o.branch_code),
    ("clean_asset_class", "RAW4", o.asset_class), ("clean_account_status", "RAW5", o.account_status),
]
_UDF_TEXT = (
    f"select o_orderkey as id, '  0-0' || cast(o_custkey as string) as RAW1, {RAW_ACCOUNT} as RAW2, {RAW_BRANCH} as RAW3, {RAW_CLASS} as RAW4, "
    f"{RAW_STATUS} as RAW5, {RAW_DATE} as RAW6, {money('o_totalprice')} as RAW7 from {{orders}}"
)


@query("udf_01_sql_functions", "select id, " + ", ".join(f"{c(r)} as {n}" for n, r, c in _ALL_RULES)
       + f", {o.iso(o.day('RAW6'))} as clean_date, cast({o.amount('RAW7')} as double) as clean_amount from ({_UDF_TEXT.format(orders='orders')}) t")
def sql_functions(t):
    register(t.spark)
    rows = t.sql(_UDF_TEXT)
    return rows.selectExpr("id", *[f"{n}({r}) as {n}" for n, r, _ in _ALL_RULES], "clean_date(RAW6) as clean_date", "clean_amount(RAW7) as clean_amount")
