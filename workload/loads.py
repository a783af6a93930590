"""Warehouse loads over the stand-in staging tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerlake.functions import labels
from ledgerlake.operators import joining, lineage, quality
from ledgerlake.plans import accounts, audit, branches, ledger, risk, schemas, warehouse

from . import oracle as o
from .registry import query
from .standins import FOLDERS

# ---------------------------------------------------------------- branches

_OFFICE = "coalesce(REGIONAL_OFFICE, 'Unassigned')"
_RO = f"""(select office, 'RO' || right('00' || cast(row_number() over (order by case upper(office) when 'HEAD OFFICE' then 0
    when 'UNASSIGNED' then 999 else 1 end, office) as varchar), 2) as ro from (select distinct {_OFFICE} as office from network) d)"""
DIM = f"""(select {o.branch_code('n.BRANCH_CODE')} as BRANCH_CODE, trim(BRANCH_NAME) as BRANCH_NAME, ro as REGIONAL_OFFICE_CODE,
    office as REGIONAL_OFFICE_NAME, '00001' as HEAD_OFFICE_CODE, coalesce(DISTRICT, 'Unknown') as DISTRICT, ADDRESS, true as IS_ACTIVE
    from network n left join {_RO} r on {_OFFICE} = office where trim(n.BRANCH_CODE) <> '')"""


@query("etl_01_branch_hierarchy", f"select * from {DIM} d", "network")
def branch_hierarchy(t):
    return branches.load_hierarchy(t("network"))


@query("win_01_office_codes", f"select office as REGIONAL_OFFICE, ro as RO_CODE from {_RO} r", "network")
def office_codes(t):
    return branches.office_codes(t("network"))


@query("jn_01_branch_to_office", f"select BRANCH_NAME, ro as RO_CODE from network left join {_RO} r on {_OFFICE} = office", "network")
def branch_to_office(t):
    rows = t("network").withColumn("REGIONAL_OFFICE", F.coalesce("REGIONAL_OFFICE", F.lit("Unassigned")))
    return rows.join(branches.office_codes(t("network")), "REGIONAL_OFFICE", "left").select("BRANCH_NAME", "RO_CODE")


@query("jn_13_upsert", f"""select coalesce(t.BRANCH_CODE, s.BRANCH_CODE) as BRANCH_CODE, coalesce(s.BRANCH_NAME, t.BRANCH_NAME) as BRANCH_NAME,
    case when s.BRANCH_CODE is null then t.DISTRICT else s.DISTRICT end as DISTRICT, coalesce(t.IS_ACTIVE, s.IS_ACTIVE) as IS_ACTIVE
    from (select {o.branch_code("cast(s_suppkey as varchar)")} as BRANCH_CODE, s_name as BRANCH_NAME, 'OLD' as DISTRICT, false as IS_ACTIVE from supplier) t
    full join {DIM} s on t.BRANCH_CODE = s.BRANCH_CODE""", "network")
def upsert(t):
    old = t.sql("select lpad(cast(s_suppkey as string), 5, '0') as BRANCH_CODE, s_name as BRANCH_NAME, 'OLD' as DISTRICT, false as IS_ACTIVE from {supplier}")
    merged = branches.load_hierarchy(t("network"), schemas.conform(old, schemas.BRANCH_HIERARCHY))
    return merged.select("BRANCH_CODE", "BRANCH_NAME", "DISTRICT", "IS_ACTIVE")


# ---------------------------------------------------------------- account snapshot

def _fact(columns: dict[str, str], source: str, where: str) -> str:
    return f"(select {', '.join(f'{e} as {n}' for n, e in columns.items())} from {source} where {where})"


def _base(key: str, category: str, table: str) -> dict[str, str]:
    return {
        "SNAPSHOT_DATE": o.day("PROC_DATE"), "ACCOUNT_NO": o.account_no(key), "CUSTOMER_NAME": "trim(CUSTOMER_NAME)",
        "BRANCH_CODE": o.branch_code("BRANCH_CODE"), "ACCOUNT_CATEGORY": f"'{category}'", "SOURCE_REPORT_ID": "REPORT_ID",
        "SOURCE_TABLE": f"'{table}'",
    }


_NULLS = {"ACCOUNT_TYPE": "cast(null as varchar)", "CURRENT_BALANCE": "cast(null as decimal(18,2))", "OUTSTANDING": "cast(null as decimal(18,2))",
          "SANCTIONED_LIMIT": "cast(null as decimal(18,2))", "INTEREST_RATE": "cast(null as decimal(8,4))", "ACCOUNT_STATUS": "cast(null as varchar)"}
_DEP_COLUMNS = _base("ACCOUNT_NUMBER", "DEPOSIT", accounts.DEPOSITS) | {
    "ACCOUNT_TYPE": "trim(ACCOUNT_TYPE)", "CURRENT_BALANCE": o.amount("CURRENT_BALANCE"), "AVAILABLE_BALANCE": o.amount("AVAILABLE_BALANCE"),
    "UNCLEARED_BALANCE": o.amount("UNCLEARED_BALANCE"), "SANCTIONED_LIMIT": o.amount("LIMIT_TEXT"), "INTEREST_RATE": o.rate("INT_RATE"),
    "ACCOUNT_STATUS": o.rate_status("INT_RATE", "STATUS"), "JOINT_HOLD_FLAG": "trim(JOINT_HOLD_FLAG)",
}
_LOAN_COLUMNS = _base("ACCOUNT_NO", "LOAN", accounts.LOANS) | {
    "ACCOUNT_TYPE": "trim(ACCOUNT_TYPE)", "OUTSTANDING": o.amount("OUTSTANDING"), "SANCTIONED_LIMIT": o.amount("LIMIT_TEXT"),
    "INTEREST_RATE": o.plain_rate("INT_RATE"), "IRREGULARITY": o.amount("IRREGULARITY"), "THEORETICAL_BALANCE": o.amount("THEO_BAL"),
    "SANCTION_DATE": o.day("SANCTION_DATE"), "NEW_IRAC": "trim(NEW_IRAC)", "OLD_IRAC": "trim(OLD_IRAC)", "EMI_DUE": o.whole("EMIS_DUE"),
    "EMI_PAID": o.whole("EMIS_PAID"), "EMI_OVERDUE": o.whole("EMIS_OVERDUE"), "ADVANCE_PAID_AMT": o.amount("ADV_PAID_AMT"),
    "ARREAR_CONDITION": "trim(ARREAR_COND)", "ACCT_MAINTAIN_BRANCH": o.branch_code("ACCT_MTAIN_BRCH"),
}
_OD_COLUMNS = _base("ACCOUNT_NUM", "CC_OD", accounts.OVERDRAFTS) | {
    "ACCOUNT_TYPE": "trim(ACCOUNT_TYP_DESC)", "CURRENT_BALANCE": o.amount("ACCOUNT_BALANCE"), "UNCLEARED_BALANCE": o.amount("UNCLEARED_BALANCE"),
    "SANCTIONED_LIMIT": o.amount("LIMIT_TEXT"), "DRAWING_POWER": o.amount("DRAWING_POWER"), "IRREGULARITY": o.amount("IRREGULARITY"),
    "INTEREST_RATE": o.plain_rate("RATE"), "ACCOUNT_STATUS": o.account_status("STATUS"), "ARREAR_CONDITION": "trim(ARREAR_COND)",
    "LIMIT_EXPIRY_DATE": o.day("LMT_EXPY_DT"), "SANCTION_DATE": o.day("SANCTION_DT"), "ACCT_MAINTAIN_BRANCH": o.branch_code("ACCT_MAINTAIN_BRANCH"),
}
_LIMIT = "(select * exclude (\"LIMIT\"), \"LIMIT\" as LIMIT_TEXT from {} s) q"
_SOURCES = {
    "deposits": (_DEP_COLUMNS, "ACCOUNT_NUMBER"), "loans": (_LOAN_COLUMNS, "ACCOUNT_NO"), "overdrafts": (_OD_COLUMNS, "ACCOUNT_NUM"),
}


def fact_sql(name: str) -> str:
    columns, key = _SOURCES[name]
    return _fact(columns, _LIMIT.format(name), f"trim({key}) <> ''")


def _shown(columns: dict[str, str]) -> str:
    out = []
    for n, e in columns.items():
        kind = schemas.ACCOUNT_SNAPSHOT.get(n) or schemas.LOAN_RISK.get(n) or schemas.AUDIT_EXCEPTIONS.get(n) or schemas.GL_SUMMARY.get(n)
        cast = {"date": "varchar", "int": "bigint"}.get(kind, "double" if kind and kind.startswith("decimal") else "")
        out.append(f"cast({n} as {cast}) as {n}" if cast else n)
    return ", ".join(out)


def _snapshot_query(key: str, name: str, build):
    columns, _ = _SOURCES[name]

    @query(key, f"select {_shown(columns)} from {fact_sql(name)} f", name)
    def run(t):
        return build(t(name)).select(*columns)


_snapshot_query("etl_02_deposit_accounts", "deposits", accounts.deposit_accounts)
_snapshot_query("etl_03_loan_accounts", "loans", accounts.loan_accounts)
_snapshot_query("etl_04_overdraft_accounts", "overdrafts", accounts.overdraft_accounts)

ACCOUNT_COLUMNS = "SNAPSHOT_DATE ACCOUNT_NO BRANCH_CODE ACCOUNT_CATEGORY ACCOUNT_TYPE CURRENT_BALANCE OUTSTANDING INTEREST_RATE ACCOUNT_STATUS".split()


def _common(name: str) -> str:
    columns, key = _SOURCES[name]
    return _fact({c: columns.get(c, _NULLS.get(c)) for c in ACCOUNT_COLUMNS}, _LIMIT.format(name), f"trim({key}) <> ''")


ACCOUNTS = "(" + " union all ".join(f"select * from {_common(n)} {n}_f" for n in _SOURCES) + ")"


def staged(t, *names: str) -> dict:
    """Stand-ins under the names of the staging tables they stand for."""
    return {_TABLES[n]: t(n) for n in names}


_TABLES = {
    "deposits": accounts.DEPOSITS, "loans": accounts.LOANS, "overdrafts": accounts.OVERDRAFTS, "npa_statement": risk.STATEMENT,
    "npa_list": risk.NPA_LIST, "probable": risk.PROBABLE, "arrears": risk.ARREARS, "drawing": risk.DRAWING, "irregular": risk.IRREGULAR,
    "excess": risk.EXCESS, "gl_totals": ledger.TOTALS, "gl_balances": ledger.BALANCES, "flows": ledger.FLOWS, "breaches": audit.BREACHES,
    "rates": audit.RATES, "large": audit.LARGE, "liens": audit.LIENS,
}
FOLDERS.update(_TABLES | {"opened": "ACCOUNT_OPENED_REPORT", "closed": "ACCOUNT_CLOSED_REPORT"})
ACCOUNT_SOURCES = "deposits loans overdrafts"


@query("set_03_account_union", f"""select ACCOUNT_CATEGORY, cast(SNAPSHOT_DATE as varchar) as SNAPSHOT_DATE, count(*) as accounts,
    {o.r2('sum(coalesce(CURRENT_BALANCE, OUTSTANDING))')} as amount from {ACCOUNTS} f group by 1, 2""", ACCOUNT_SOURCES)
def account_union(t):
    rows = accounts.account_snapshot(staged(t, *ACCOUNT_SOURCES.split()))
    return rows.groupBy("ACCOUNT_CATEGORY", "SNAPSHOT_DATE").agg(
        F.count("*").alias("accounts"), F.sum(F.coalesce("CURRENT_BALANCE", "OUTSTANDING")).alias("amount"))


@query("flt_06_incremental_day", f"""select ACCOUNT_CATEGORY, count(*) as accounts from {ACCOUNTS} f where SNAPSHOT_DATE = date '2025-04-15' group by 1""",
       ACCOUNT_SOURCES)
def incremental_day(t):
    return accounts.account_snapshot(staged(t, *ACCOUNT_SOURCES.split()), "2025-04-15").groupBy("ACCOUNT_CATEGORY").agg(F.count("*").alias("accounts"))


# ---------------------------------------------------------------- risk: the inserts and updates one after another

_MONEY_NULL, _TEXT_NULL, _DATE_NULL = "cast(null as decimal(18,2))", "cast(null as varchar)", "cast(null as date)"


def _risk_row(key: str, table: str, branch: str = "BRANCH_CODE", **columns: str) -> dict[str, str]:
    fixed = {
        "SNAPSHOT_DATE": o.day("PROC_DATE"), "ACCOUNT_NO": o.account_no(key), "BRANCH_CODE": o.branch_code(branch),
        "SOURCE_REPORT_ID": "REPORT_ID", "SOURCE_TABLE": f"'{table}'", "IS_PROBABLE_NPA": "false", "IS_CONFIRMED_NPA": "false",
    } | columns
    empty = {"decimal(18,2)": _MONEY_NULL, "string": _TEXT_NULL, "date": _DATE_NULL}
    return {c: fixed.get(c, empty.get(kind)) for c, kind in schemas.LOAN_RISK.items()}


_A = o.amount
_LONG = " + ".join(f"coalesce({_A(c)}, 0)" for c in risk.LONG_SLABS)
_RISK = {
    "npa_statement": ("ACCT_NO", _risk_row(
        "ACCT_NO", risk.STATEMENT, "coalesce(BRANCH_CODE, BR_NO)", CUSTOMER_NO=o.customer_id("CUST_NO"), CUSTOMER_NAME="trim(NAME)",
        PRODUCT_DESCRIPTION="trim(PROD_DESCRIPTION)", SYSTEM_CODE="trim(SYS)", NPA_CLASSIFICATION=o.asset_class("NI"), OLD_IRAC="trim(OI)",
        NEW_IRAC="trim(NI)", NPA_DATE=o.day("NPA_DATE"), LAST_ARREARS_DATE=o.day("LST_ARR_D"), BALANCE_OUTSTANDING=_A("BAL_OUTSTAND"),
        OVERDUE_INTEREST=_A("OVERDUE_INT"), INCA=_A("INCA"), UIPY=_A("UIPY"), IRREGULAR_AMOUNT=_A("IRR_AMT"), IS_CONFIRMED_NPA="true")),
    "npa_list": ("ACCOUNT_NUMBER", _risk_row(
        "ACCOUNT_NUMBER", risk.NPA_LIST, CUSTOMER_NAME="trim(CUSTOMER_NAME)", NPA_CLASSIFICATION=o.asset_class("NEW_IRAC"), OLD_IRAC="trim(OLD_IRAC)",
        NEW_IRAC="trim(NEW_IRAC)", NPA_DATE=o.day("NPA_DATE"), BALANCE_OUTSTANDING=_A("OUTSTANDING"), OUTSTANDING=_A("OUTSTANDING"), INCA=_A("INCA"),
        UIPY=_A("UIPY"), ARREAR_CONDITION="trim(ARR_COND)", IS_CONFIRMED_NPA="true")),
    "probable": ("ACCOUNT_NO", _risk_row(
        "ACCOUNT_NO", risk.PROBABLE, CUSTOMER_NAME="trim(ACCOUNT_NAME)", PRODUCT_DESCRIPTION="trim(FACILITY)", OUTSTANDING=_A("OUTSTANDING"),
        LIMIT_AMOUNT=_A("\"LIMIT\""), RISK_GRADE="trim(RISK_GRADE)", IS_PROBABLE_NPA="true")),
    "arrears": ("LOAN_ACCOUNT", _risk_row(
        "LOAN_ACCOUNT", risk.ARREARS, PRODUCT_DESCRIPTION="trim(PRODUCT_DESCRIPTION)", BALANCE_OUTSTANDING=_A("ACCOUNT_BALANCE"),
        **{c: _A(c) for c in risk.SLABS}, ARREARS_3Y_PLUS=f"cast({_LONG} as decimal(18,2))")),
    "irregular": ("ACCOUNT_NO", _risk_row(
        "ACCOUNT_NO", risk.IRREGULAR, CUSTOMER_NAME="trim(NAME_OF_BORROWER)", PRODUCT_DESCRIPTION="trim(DESCRIPT)", OUTSTANDING=_A("OUTSTANDING"),
        IRREGULAR_AMOUNT=_A("IRREGULARITY"), OLD_IRAC=o.asset_class("OLD_BAD_IND"), NEW_IRAC=o.asset_class("NEW_BAD_IND"))),
    "excess": ("ACCOUNT_NUMBER", _risk_row(
        "ACCOUNT_NUMBER", risk.EXCESS, CUSTOMER_NAME="trim(NAME_OF_BORROWER)", PRODUCT_DESCRIPTION="trim(PRODUCT_SUBPRODUCT_TYPE)",
        OUTSTANDING=_A("OUTSTANDING"), LIMIT_AMOUNT=_A("LIMIT_AMOUNT"), DRAWING_POWER=_A("DRAWING_POWER"), IRREGULAR_AMOUNT=_A("IRREGULARITY"))),
}
RISK_COLUMNS = list(schemas.LOAN_RISK)
_LIST = ", ".join(RISK_COLUMNS)


def _insert(name: str, into: str | None) -> str:
    key, columns = _RISK[name]
    rows = _fact(columns, f"{name} s", f"trim({key}) <> ''")
    fresh = f"select * from {rows} x"
    if into is None:
        return fresh
    return f"select * from {into} union all {fresh} where not exists (select 1 from {into} r where r.ACCOUNT_NO = x.ACCOUNT_NO and r.SNAPSHOT_DATE = x.SNAPSHOT_DATE)"


def _update(into: str, source: str, assign: dict[str, str]) -> str:
    cells = [f"case when s.ACCOUNT_NO is not null then {assign[c]} else r.{c} end as {c}" if c in assign else f"r.{c}" for c in RISK_COLUMNS]
    return f"select {', '.join(cells)} from {into} r left join {source} s on s.ACCOUNT_NO = r.ACCOUNT_NO and s.SNAPSHOT_DATE = r.SNAPSHOT_DATE"


_ARREARS_ROWS = _fact(_RISK["arrears"][1], "arrears a", "true")
_DRAWING_ROWS = _fact({
    "SNAPSHOT_DATE": o.day("PROC_DATE"), "ACCOUNT_NO": o.account_no("ACCOUNT_NO"), "DRAWING_POWER": _A("DRAWING_POWER"),
    "DP_VARIANCE": _A("ACTUAL_VARIANCE"), "OUTSTANDING": _A("OUTSTANDING"), "BENCHMARK_LEVEL": "trim(BENCHMARK_LEVEL)",
    "TOLERANCE_LEVEL": "trim(TOLERANCE_LEVEL)"}, "drawing d", "true")
_STEPS = [
    ("step_a", _insert("npa_statement", None)), ("step_b", _insert("npa_list", "step_a")), ("step_c", _insert("probable", "step_b")),
    ("step_d1", _update("step_c", _ARREARS_ROWS, {c: f"s.{c}" for c in [*risk.SLABS, "ARREARS_3Y_PLUS"]})), ("step_d", _insert("arrears", "step_d1")),
    ("step_e", _update("step_d", _DRAWING_ROWS, {c: f"s.{c}" for c in ("DRAWING_POWER", "DP_VARIANCE", "BENCHMARK_LEVEL", "TOLERANCE_LEVEL")}
                       | {"OUTSTANDING": "coalesce(r.OUTSTANDING, s.OUTSTANDING)"})),
    ("step_f", _insert("irregular", "step_e")), ("step_g", _insert("excess", "step_f")),
]
RISK_SOURCES = "npa_statement npa_list probable arrears drawing irregular excess"


def risk_upto(last: str) -> str:
    steps = []
    for name, sql in _STEPS:
        steps.append(f"{name} as materialized ({sql})")
        if name == last:
            break
    return "(with " + ", ".join(steps) + f" select {_LIST} from {last})"


def _risk_query(key: str, step: str, names: str) -> None:
    @query(key, f"select {_shown({c: c for c in RISK_COLUMNS})} from {risk_upto(step)} f", names)
    def run(t):
        return risk.loan_risk(staged(t, *names.split()))


_risk_query("etl_05_npa_statement", "step_a", "npa_statement")
_risk_query("etl_06_npa_list", "step_b", "npa_statement npa_list")
_risk_query("etl_07_probable_npa", "step_c", "npa_statement npa_list probable")
_risk_query("etl_08_arrears", "step_d", "npa_statement npa_list probable arrears")
_risk_query("etl_09_drawing_power", "step_e", "npa_statement npa_list probable arrears drawing")
_risk_query("etl_10_irregular", "step_f", "npa_statement npa_list probable arrears drawing irregular")
_risk_query("etl_11_excess_draw", "step_g", RISK_SOURCES)


@query("jn_05_insert_missing", """select source, count(*) as accounts from (
    select ACCT_NO as a, 'npa_statement' as source from npa_statement union all
    select ACCOUNT_NUMBER, 'npa_list' from npa_list l where not exists (select 1 from npa_statement s where s.ACCT_NO = l.ACCOUNT_NUMBER)) u group by source""",
       "npa_statement npa_list")
def insert_missing(t):
    a = t("npa_statement").select(F.col("ACCT_NO").alias("a"), F.lit("npa_statement").alias("source"))
    b = t("npa_list").select(F.col("ACCOUNT_NUMBER").alias("a"), F.lit("npa_list").alias("source"))
    return joining.insert_missing(a, b, ["a"]).groupBy("source").agg(F.count("*").alias("accounts"))


@query("jn_06_update_from", """select p.ACCOUNT_NO, case when d.ACCOUNT_NO is null then 'none' else d.BENCHMARK_LEVEL end as level, p.RISK_GRADE
    from probable p left join drawing d on p.ACCOUNT_NO = d.ACCOUNT_NO""", "probable drawing")
def update_from(t):
    current = t("probable").select("ACCOUNT_NO", F.lit("none").alias("level"), "RISK_GRADE")
    source = t("drawing").select("ACCOUNT_NO", F.col("BENCHMARK_LEVEL"))
    return joining.update_from(current, source, ["ACCOUNT_NO"], {"level": F.col("s.BENCHMARK_LEVEL")})


@query("prj_09_long_slabs", f"select LOAN_ACCOUNT, cast({_LONG} as double) as arrears_3y_plus from arrears", "arrears")
def long_slabs(t):
    from ledgerlake.functions import cleanse

    return t("arrears").select("LOAN_ACCOUNT", labels.null_safe_sum(*[cleanse.amount(c) for c in risk.LONG_SLABS]).alias("arrears_3y_plus"))


# ---------------------------------------------------------------- ledger

def _gl_rows(name: str, code: str, must: str, columns: dict[str, str], table: str) -> str:
    full = {"SNAPSHOT_DATE": o.day("PROC_DATE"), "BRANCH_CODE": o.branch_code("BRANCH_CODE"), "GL_CLASS_CODE": f"trim({code})"} | columns | {
        "SOURCE_REPORT_ID": "min(REPORT_ID)", "SOURCE_TABLE": f"'{table}'"}
    empty = {"decimal(18,2)": _MONEY_NULL, "string": _TEXT_NULL, "int": "cast(null as bigint)"}
    cells = ", ".join(f"{full.get(c, empty.get(k))} as {c}" for c, k in schemas.GL_SUMMARY.items())
    return f"(select {cells} from {name} s where trim({must}) <> '' group by 1, 2, 3)"


def _s(c: str) -> str:
    return f"sum({_A(c)})"


_GL_A = _gl_rows("gl_totals", "GL_CLASS_CODE", "GL_CLASS_CODE", {
    "PRODUCT_NAME": "max(trim(NAME))", "ACCOUNT_COUNT": f"cast(sum({o.whole('ACT_TOTAL')}) as bigint)", "TOTAL_DR_BALANCE": _s("TOTAL_AMOUNT"),
    "TOTAL_INTEREST": _s("TOTAL_INTEREST"), "TOTAL_DR_OD_INT": _s("TOTAL_DR_OD_INT"), "TOTAL_UNCLEARED": _s("TOTAL_UNCLEARED_AMT"),
    "TOTAL_COLLECTION": _s("TOTAL_COLLECTION_AMT")}, ledger.TOTALS)
_GL_B = _gl_rows("gl_balances", "GL_CLASS_CODE", "GL_CLASS_CODE", {
    "ACCOUNT_COUNT": "count(*)", "TOTAL_DR_BALANCE": _s("DR_BALANCE"), "TOTAL_CR_BALANCE": _s("CR_BALANCE"), "TOTAL_INTEREST": _s("INT_BALANCE"),
    "TOTAL_DR_OD_INT": _s("OD_DR_INT_BAL"), "TOTAL_UNCLEARED": _s("UNCLRED_BAL"), "TOTAL_COLLECTION": _s("COLL_AMT")}, ledger.BALANCES)
_GL_C = _gl_rows("flows", "PROD_CODE", "ACCOUNT_NO", {"PRODUCT_NAME": "max(trim(PROD_DESC))", "ACCOUNT_COUNT": "count(*)"} | {
    target: _s(source) for source, target in ledger.FLOW_COLUMNS.items()}, "GNBD7376")
_GL_COLUMNS = list(schemas.GL_SUMMARY)
_SAME = "g.SNAPSHOT_DATE = f.SNAPSHOT_DATE and g.BRANCH_CODE = f.BRANCH_CODE"
_GL_STEPS = f"""with a as materialized (select * from {_GL_A} x), b as materialized (select * from a union all select * from {_GL_B} f
    where not exists (select 1 from a g where {_SAME} and g.GL_CLASS_CODE = f.GL_CLASS_CODE)), f as materialized (select * from {_GL_C} x),
    m as (select g.SNAPSHOT_DATE as d, g.BRANCH_CODE as br, g.GL_CLASS_CODE as gl, f.* from b g join f on {_SAME}
      and contains(upper(g.GL_CLASS_CODE), upper(f.GL_CLASS_CODE))
      qualify row_number() over (partition by g.SNAPSHOT_DATE, g.BRANCH_CODE, g.GL_CLASS_CODE order by length(f.GL_CLASS_CODE) desc, f.GL_CLASS_CODE) = 1),
    c as (select {', '.join(f"case when m.gl is null then b.{x} else m.{x} end as {x}" if x in ledger.FLOW_COLUMNS.values() else f'b.{x}' for x in _GL_COLUMNS)}
      from b left join m on m.d = b.SNAPSHOT_DATE and m.br = b.BRANCH_CODE and m.gl = b.GL_CLASS_CODE)"""
_GL_ALL = f"""({_GL_STEPS} select * from c union all select * from f where not exists (
    select 1 from b g where {_SAME} and g.GL_CLASS_CODE = f.GL_CLASS_CODE))"""
_GL_SHOWN = _shown({c: c for c in _GL_COLUMNS})
GL_SOURCES = "gl_totals gl_balances flows"


@query("etl_12_gl_totals", f"select {_GL_SHOWN} from {_GL_A} g", "gl_totals")
def gl_totals(t):
    return ledger.gl_summary(staged(t, "gl_totals"))


@query("etl_13_gl_balances", f"""select {_GL_SHOWN} from (select * from {_GL_A} a union all select * from {_GL_B} f where not exists (
    select 1 from {_GL_A} g where {_SAME} and g.GL_CLASS_CODE = f.GL_CLASS_CODE)) u""", "gl_totals gl_balances")
def gl_balances(t):
    return ledger.gl_summary(staged(t, "gl_totals", "gl_balances"))


@query("etl_14_flow_updates", f"select {_GL_SHOWN} from ({_GL_STEPS} select * from c) u", GL_SOURCES)
def flow_updates(t):
    rows = ledger.gl_summary(staged(t, *GL_SOURCES.split()))
    return rows.filter(F.col("SOURCE_TABLE") != "GNBD7376")


@query("etl_15_flow_inserts", f"select {_GL_SHOWN} from {_GL_ALL} u", GL_SOURCES)
def flow_inserts(t):
    return ledger.gl_summary(staged(t, *GL_SOURCES.split()))


@query("jn_07_contained_codes", """select distinct a.GL_CLASS_CODE, f.PROD_CODE from gl_totals a join (select distinct PROD_CODE from flows) f
    on contains(upper(a.GL_CLASS_CODE), upper(f.PROD_CODE))""", "gl_totals flows")
def contained(t):
    return joining.contained_codes(t("gl_totals"), t("flows"))


@query("agg_08_group_by_cleaned", f"""select {o.iso(o.day('PROC_DATE'))} as day, {o.branch_code('BRANCH_CODE')} as branch, trim(GL_CLASS_CODE) as gl_class,
    count(*) as rows, cast(sum({_A('DR_BALANCE')}) as double) as debit from gl_balances group by 1, 2, 3""", "gl_balances")
def group_by_cleaned(t):
    from ledgerlake.functions import cleanse

    return t("gl_balances").groupBy(
        cleanse.date("PROC_DATE").alias("day"), cleanse.branch_code("BRANCH_CODE").alias("branch"), cleanse.trimmed("GL_CLASS_CODE").alias("gl_class"),
    ).agg(F.count("*").alias("rows"), F.sum(cleanse.amount("DR_BALANCE")).alias("debit"))


# ---------------------------------------------------------------- audit

def _audit_row(name: str, key: str, kind: str, table: str, **columns: str) -> str:
    full = {"SNAPSHOT_DATE": o.day("PROC_DATE"), "BRANCH_CODE": o.branch_code("BRANCH_CODE"), "ACCOUNT_NO": o.account_no(key),
            "EXCEPTION_TYPE": f"'{kind}'", "SOURCE_REPORT_ID": "REPORT_ID", "SOURCE_TABLE": f"'{table}'"} | columns
    empty = {"decimal(18,2)": _MONEY_NULL, "decimal(8,4)": "cast(null as decimal(8,4))", "string": _TEXT_NULL, "date": _DATE_NULL}
    return _fact({c: full.get(c, empty.get(k)) for c, k in schemas.AUDIT_EXCEPTIONS.items()}, f"{name} s", f"trim({key}) <> ''")


def _severity(x: str, steps: list[tuple[float, str]], low: str) -> str:
    return "case " + " ".join(f"when {x} >= {v} then '{n}'" for v, n in steps) + f" else '{low}' end"


_P, _E = o.plain_rate("PRODUCT_INT_RATE"), o.plain_rate("EFFECTIVE_INT_RATE")
_DIFF = f"abs(coalesce({_E}, 0) - coalesce({_P}, 0))"
AUDIT_PARTS = {
    "breaches": _audit_row(
        "breaches", "ACCOUNT_NO", "TXN_LIMIT_BREACH", audit.BREACHES, CUSTOMER_NAME="trim(CUSTOMER_NAME)", TRAN_CODE="trim(TRAN_CODE)",
        JOURNAL_NO="trim(JRNL_NO)", AMOUNT=_A("AMOUNT"), OUTSTANDING=_A("OUTSTANDING"), LIMIT_AMOUNT=_A("LIMIT_AMOUNT"), ERROR_DESC="trim(ERROR_DESC)",
        SUP_ID="trim(SUP_ID)", SUP_ERR_NO="trim(SUP_ERR_NO)",
        SEVERITY=_severity(_A("AMOUNT"), [(1000000, "CRITICAL"), (500000, "HIGH"), (100000, "MEDIUM")], "LOW")),
    "rates": _audit_row(
        "rates", "ACCOUNT_NUMBER", "INT_RATE_VARIANCE", audit.RATES, CUSTOMER_NAME="trim(CUSTOMER_NAME)", SANCTION_AMOUNT=_A("SANCTION_AMOUNT"),
        ACCOUNT_TYPE="trim(ACCT_TYPE)", SUB_TYPE="trim(SUB_TYPE)", PRODUCT_INT_RATE=_P, EFFECTIVE_INT_RATE=_E, RATE_VARIANCE=_DIFF,
        SEVERITY=_severity(_DIFF, [(2, "CRITICAL"), (1, "HIGH"), (0.5, "MEDIUM")], "LOW")),
    "large": _audit_row(
        "large", "ACCOUNT_NO", "HIGH_VALUE_TXN", audit.LARGE, CUSTOMER_NAME="trim(ACCOUNT_NAME)", AMOUNT=_A("AMOUNT"), TRANSACTION_DATE=o.day("TRANS_DATE"),
        NARRATION="trim(NARRATION)", SEVERITY=_severity(f"abs(coalesce({_A('AMOUNT')}, 0))", [(5000000, "CRITICAL"), (1000000, "HIGH")], "MEDIUM")),
    "liens": _audit_row(
        "liens", "ACCOUNT_NO", "LIEN_OPERATION", audit.LIENS, ACCOUNT_TYPE="trim(TYPE_OF_ACCOUNT)", LIEN_AMOUNT=_A("LIEN_AMOUNT"),
        LIEN_ACTION="case upper(trim(MARK_REM)) when 'MARK' then 'MARK' when 'REM' then 'REMOVE' else trim(MARK_REM) end", LIEN_REASON="trim(REASON)",
        USER_ID="trim(USER_ID)", CHECKER_ID="trim(CHK_ID)",
        SEVERITY=_severity(f"abs(coalesce({_A('LIEN_AMOUNT')}, 0))", [(500000, "HIGH"), (100000, "MEDIUM")], "LOW")),
}
AUDIT = "(" + " union all ".join(f"select * from {sql} {n}_x" for n, sql in AUDIT_PARTS.items()) + ")"
AUDIT_SOURCES = "breaches rates large liens"


def _audit_query(key: str, name: str):
    @query(key, f"select {_shown({c: c for c in schemas.AUDIT_EXCEPTIONS})} from {AUDIT_PARTS[name]} f", name)
    def run(t):
        return audit.audit_exceptions(staged(t, name))


_audit_query("etl_16_limit_breaches", "breaches")
_audit_query("etl_17_rate_variances", "rates")
_audit_query("etl_18_large_transactions", "large")
_audit_query("etl_19_lien_operations", "liens")

_MOVED = "trim(ACCOUNT_NAME) as CUSTOMER_NAME, " + f"{o.account_no('ACCOUNT_NUMBER')} as ACCOUNT_NO, {o.branch_code('BRANCH_CODE')} as BRANCH_CODE, " + (
    "case when PRODUCT like '6%' then 'LOAN' else 'DEPOSIT' end as ACCOUNT_CATEGORY, trim(PRODUCT) as PRODUCT_CODE")


@query("etl_20_opened_accounts", f"""select {o.iso(o.day('OPENED_DATE'))} as OPENED_DATE, {_MOVED},
    cast(cast(coalesce(nullif(replace(BALANCE, ',', ''), ''), '0') as decimal(18,2)) as double) as BALANCE from opened""", "opened")
def opened_accounts(t):
    return accounts.opened_accounts(t("opened"))


@query("etl_21_closed_accounts", f"select {o.iso(o.day('CLOSED_DATE'))} as CLOSED_DATE, {_MOVED} from closed", "closed")
def closed_accounts(t):
    return accounts.closed_accounts(t("closed"))


# ---------------------------------------------------------------- checks

@query("dq_01_unknown_codes", """select coalesce(trim(MARK_REM), '') as value, count(*) as rows, 'LIEN_ACTION' as column_name from liens
    where trim(MARK_REM) not in ('mark', 'REM') group by 1""", "liens")
def unknown_codes(t):
    rows = t("liens").withColumn("LIEN_ACTION", labels.lien_action("MARK_REM"))
    return quality.code_violations(rows, "LIEN_ACTION", ("MARK", "REMOVE"))


@query("dq_02_duplicate_keys", f"""select cast({o.day('PROC_DATE')} as varchar) as SNAPSHOT_DATE, ACCOUNT_NO, count(*) as rows from (
    select PROC_DATE, ACCOUNT_NO from liens union all select PROC_DATE, ACCOUNT_NO from probable) u group by PROC_DATE, ACCOUNT_NO having count(*) > 1""",
       "liens probable")
def duplicate_keys(t):
    from ledgerlake.functions import cleanse

    rows = t("liens").select("PROC_DATE", "ACCOUNT_NO").union(t("probable").select("PROC_DATE", "ACCOUNT_NO"))
    return quality.duplicate_keys(rows.select(cleanse.date("PROC_DATE").alias("SNAPSHOT_DATE"), "ACCOUNT_NO"), ["SNAPSHOT_DATE", "ACCOUNT_NO"])


@query("dq_03_missing_values", """select ACCT_NO, BRANCH_CODE, case when BRANCH_CODE is null then 'BRANCH_CODE' end as missing
    from npa_statement where BRANCH_CODE is null""", "npa_statement")
def missing_values(t):
    return quality.missing_values(t("npa_statement").select("ACCT_NO", "BRANCH_CODE"), ["ACCT_NO", "BRANCH_CODE"])


# ---------------------------------------------------------------- whole runs

def shared_folder(spark) -> str:
    """A new folder below the cluster's shared one; a local one only where none is named (tests)."""
    import uuid

    return f"{lineage.shared_folder(spark)}/{uuid.uuid4().hex}"


_STAGED = f"{ACCOUNT_SOURCES} {RISK_SOURCES} {GL_SOURCES} {AUDIT_SOURCES}"


def _stage(t, names: str) -> str:
    """The folder of the staging tables, with at least the named ones: the stand-ins as they are stored."""
    for name in names.split():
        t.stored(name)
    return t.staging()


def _warehouse(t, names: str) -> warehouse.Warehouse:
    root = shared_folder(t.spark)
    t("network").write.mode("overwrite").parquet(f"{root}/dw/BRANCH_NETWORK")
    return warehouse.Warehouse(t.spark, _stage(t, names), f"{root}/dw")


_LOADS = {
    warehouse.ACCOUNTS: (warehouse.load_accounts, ACCOUNT_SOURCES), warehouse.RISK: (warehouse.load_risk, RISK_SOURCES),
    warehouse.AUDIT: (warehouse.load_audit, AUDIT_SOURCES),
}


def fact(t, name: str):
    """A loaded fact of a warehouse that is there before the query: stored by date."""
    load, sources = _LOADS[name]
    root = t.place(f"fact {name}", lambda path: load(warehouse.Warehouse(t.spark, _stage(t, sources), path)))
    return warehouse.Warehouse(t.spark, "", root).table(name)


#: Each fact with its date, key and amount columns.
_MEASURED = {
    warehouse.BRANCHES: (None, "BRANCH_CODE", None), warehouse.ACCOUNTS: ("SNAPSHOT_DATE", "ACCOUNT_NO", "coalesce(CURRENT_BALANCE, OUTSTANDING)"),
    warehouse.RISK: ("SNAPSHOT_DATE", "ACCOUNT_NO", "coalesce(BALANCE_OUTSTANDING, OUTSTANDING)"), warehouse.GL: ("SNAPSHOT_DATE", "GL_CLASS_CODE", "TOTAL_DR_BALANCE"),
    warehouse.AUDIT: ("SNAPSHOT_DATE", "ACCOUNT_NO", None), warehouse.OPENED: ("OPENED_DATE", "ACCOUNT_NO", None), warehouse.CLOSED: ("CLOSED_DATE", "ACCOUNT_NO", None),
}


def _measures(name: str) -> str:
    """Rows, keys, the sum of the keys' last digits and of the amounts: the same text on both sides."""
    day, key, amount = _MEASURED[name]
    digits = f"sum(cast(coalesce(nullif(regexp_replace({key}, '[^0-9]', '', 'g'), ''), '0') as decimal(38,0)) % 1000003)"
    return f"""'{name}' as table_name, {f"cast({day} as varchar)" if day else "'-'"} as day, count(*) as rows, count(distinct {key}) as keys,
        cast({digits} as bigint) as key_sum, {f"cast(coalesce(sum({amount}), 0) as double)" if amount else "0.0::double"} as amount"""


def _measured(w: warehouse.Warehouse, names: list[str]):
    def one(name: str):
        day, key, amount = _MEASURED[name]
        rows = w.table(name)
        digits = F.coalesce(F.nullif(F.regexp_replace(key, "[^0-9]", ""), F.lit("")), F.lit("0")).cast("decimal(38,0)") % 1000003
        total = F.coalesce(F.sum(F.expr(amount)), F.lit(0)).cast("double") if amount else F.lit(0.0)
        grouped = rows.groupBy((F.col(day).cast("string") if day else F.lit("-")).alias("day"))
        out = grouped.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.sum(digits).cast("bigint").alias("key_sum"), total.alias("amount"))
        return out.select(F.lit(name).alias("table_name"), "day", "rows", "keys", "key_sum", "amount")

    return reduce(lambda a, b: a.unionByName(b), map(one, names))


_LOADED = {
    warehouse.BRANCHES: f"{DIM} d", warehouse.ACCOUNTS: f"{ACCOUNTS} a", warehouse.RISK: f"{risk_upto('step_g')} r", warehouse.GL: f"{_GL_ALL} g", warehouse.AUDIT: f"{AUDIT} x",
    warehouse.OPENED: f"(select {o.day('OPENED_DATE')} as OPENED_DATE, {o.account_no('ACCOUNT_NUMBER')} as ACCOUNT_NO from opened s) p",
    warehouse.CLOSED: f"(select {o.day('CLOSED_DATE')} as CLOSED_DATE, {o.account_no('ACCOUNT_NUMBER')} as ACCOUNT_NO from closed s) c",
}


def _loaded(name: str, where: str = "") -> str:
    return f"select {_measures(name)} from {_LOADED[name]} {where} group by {'2' if _MEASURED[name][0] else 'all'}"


@query("etl_22_full_load", " union all ".join(f"(select * from ({_loaded(n)}) q)" for n in _LOADED), f"network {_STAGED} opened closed")
def full_load(t):
    w = _warehouse(t, f"{_STAGED} opened closed")
    warehouse.full_load(w)
    return _measured(w, list(_LOADED))


_DAY = "where SNAPSHOT_DATE = date '2025-04-15'"
_DAILY = [warehouse.ACCOUNTS, warehouse.RISK, warehouse.AUDIT]


@query("etl_23_incremental_load", " union all ".join(f"(select * from ({_loaded(n, _DAY)}) q)" for n in _DAILY), _STAGED)
def incremental_load(t):
    w = _warehouse(t, _STAGED)
    warehouse.incremental_load(w, "2025-04-15")
    warehouse.incremental_load(w, "2025-04-15")
    return _measured(w, _DAILY)
