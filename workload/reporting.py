"""Dashboard and report queries over stand-in staging tables and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.plans import branches, dashboards, reports, warehouse
from ledgerlake.sources import staging

from . import oracle as o
from .loads import ACCOUNT_SOURCES, ACCOUNTS, AUDIT, AUDIT_SOURCES, DIM, RISK_SOURCES, fact
from .registry import query
from .relational import _AGEING, RISK, accounts_fact, risk_fact

DAY = o.day("PROC_DATE")
_FACTS = f"with acc as materialized (select * from {ACCOUNTS} a), "
_RISKS = f"risks as materialized (select * from {RISK} r)"
_LAST = "SNAPSHOT_DATE = (select max(SNAPSHOT_DATE) from acc)"
_LAST_RISK = "SNAPSHOT_DATE = (select max(SNAPSHOT_DATE) from risks)"


def d(x: str) -> str:
    return f"cast({x} as double)"


@query("q_01_executive_kpis", f"""select * from ({_FACTS}{_RISKS}, ex as (select * from {AUDIT} x) select cast(max(SNAPSHOT_DATE) as varchar) as REPORT_DATE,
    count(*) filter (where ACCOUNT_CATEGORY = 'DEPOSIT') as TOTAL_DEPOSIT_ACCOUNTS, count(*) filter (where ACCOUNT_CATEGORY = 'LOAN') as TOTAL_LOAN_ACCOUNTS,
    count(*) filter (where ACCOUNT_CATEGORY = 'CC_OD') as TOTAL_CCOD_ACCOUNTS, count(ACCOUNT_NO) as TOTAL_ACCOUNTS,
    {d("sum(case when ACCOUNT_CATEGORY = 'DEPOSIT' then coalesce(CURRENT_BALANCE, 0) else 0 end)")} as TOTAL_DEPOSITS,
    {d("sum(case when ACCOUNT_CATEGORY = 'LOAN' then coalesce(OUTSTANDING, 0) else 0 end)")} as TOTAL_ADVANCES,
    {d("sum(case when ACCOUNT_CATEGORY = 'CC_OD' then abs(coalesce(CURRENT_BALANCE, 0)) else 0 end)")} as TOTAL_CCOD_OUTSTANDING,
    count(*) filter (where ACCOUNT_STATUS = 'OPEN') as OPEN_ACCOUNTS, count(*) filter (where ACCOUNT_STATUS = 'CLOSED') as CLOSED_ACCOUNTS,
    (select count(*) from risks where {_LAST} and IS_CONFIRMED_NPA) as TOTAL_NPA_ACCOUNTS,
    (select {d('coalesce(sum(BALANCE_OUTSTANDING), 0)')} from risks where {_LAST} and IS_CONFIRMED_NPA) as TOTAL_NPA_OUTSTANDING,
    (select count(*) from ex where {_LAST} and SEVERITY in ('HIGH', 'CRITICAL')) as CRITICAL_EXCEPTIONS from acc where {_LAST}) q""",
       f"{ACCOUNT_SOURCES} {RISK_SOURCES} {AUDIT_SOURCES}")
def executive_kpis(t):
    return dashboards.executive_kpis(accounts_fact(t), risk_fact(t), fact(t, warehouse.AUDIT))


_AVG = "round(cast(sum(INTEREST_RATE) as double) / count(INTEREST_RATE), 4)"


@query("q_02_business_mix", f"""select * from ({_FACTS}x as (select 1) select ACCOUNT_CATEGORY, count(ACCOUNT_NO) as ACCOUNT_COUNT,
    {d("sum(case ACCOUNT_CATEGORY when 'DEPOSIT' then coalesce(CURRENT_BALANCE, 0) when 'LOAN' then coalesce(OUTSTANDING, 0) else abs(coalesce(CURRENT_BALANCE, 0)) end)")} as TOTAL_VOLUME,
    {_AVG} as AVG_INTEREST_RATE, {d('min(INTEREST_RATE)')} as MIN_INTEREST_RATE, {d('max(INTEREST_RATE)')} as MAX_INTEREST_RATE
    from acc where {_LAST} group by 1) q""", ACCOUNT_SOURCES, 4)
def business_mix(t):
    return dashboards.business_mix(accounts_fact(t))


_BOOK = "sum(case ACCOUNT_CATEGORY when 'DEPOSIT' then coalesce(CURRENT_BALANCE, 0) else coalesce(OUTSTANDING, abs(CURRENT_BALANCE), 0) end)"


@query("q_03_product_portfolio", f"""select * from ({_FACTS}g as (select ACCOUNT_CATEGORY, coalesce(ACCOUNT_TYPE, 'UNKNOWN') as PRODUCT_TYPE, count(ACCOUNT_NO) as ACCOUNT_COUNT,
    {_BOOK} as b, {_AVG} as AVG_RATE from acc where {_LAST} group by ACCOUNT_CATEGORY, ACCOUNT_TYPE)
    select ACCOUNT_CATEGORY, PRODUCT_TYPE, ACCOUNT_COUNT, {d('b')} as TOTAL_BALANCE, AVG_RATE,
    row_number() over (partition by ACCOUNT_CATEGORY order by b desc, PRODUCT_TYPE) as RNK from g qualify RNK <= 3) q""", ACCOUNT_SOURCES, 4)
def product_portfolio(t):
    return dashboards.product_portfolio(accounts_fact(t), n=3)


def _sum0(c: str) -> str:
    return d(f"sum(coalesce({c}, 0))")


@query("q_04_npa_breakdown", f"""select * from (with {_RISKS} select coalesce(NPA_CLASSIFICATION, 'UNCLASSIFIED') as ASSET_CATEGORY, count(ACCOUNT_NO) as ACCOUNT_COUNT,
    {_sum0('BALANCE_OUTSTANDING')} as TOTAL_OUTSTANDING, {_sum0('INCA')} as TOTAL_INCA, {_sum0('UIPY')} as TOTAL_UIPY,
    {_sum0('OVERDUE_INTEREST')} as TOTAL_OVERDUE_INTEREST, {_sum0('IRREGULAR_AMOUNT')} as TOTAL_IRREGULAR,
    count(*) filter (where IS_PROBABLE_NPA) as PROBABLE_NPA_COUNT, count(*) filter (where IS_CONFIRMED_NPA) as CONFIRMED_NPA_COUNT,
    round({_sum0('BALANCE_OUTSTANDING')} * 100 / nullif((select {_sum0('BALANCE_OUTSTANDING')} from risks where {_LAST_RISK}), 0), 4) as PORTFOLIO_PERCENTAGE
    from risks where {_LAST_RISK} group by NPA_CLASSIFICATION) q""", RISK_SOURCES, 4)
def npa_breakdown(t):
    return dashboards.npa_breakdown(risk_fact(t))


@query("q_05_arrears_ageing", f"select * from (with facts as materialized (select * from {RISK} r) {_AGEING}) u", RISK_SOURCES)
def arrears_ageing(t):
    return dashboards.arrears_ageing(risk_fact(t))


def _ranked(facts: str, figures: str, measure: str, where: str, n: int, high: str, low: str) -> str:
    return f"""select * from ({facts}, g as (select f.BRANCH_CODE, BRANCH_NAME, REGIONAL_OFFICE_NAME, DISTRICT, {figures}, {measure} as m from {where}
      group by f.BRANCH_CODE, BRANCH_NAME, REGIONAL_OFFICE_NAME, DISTRICT) select * exclude (m), case when rank() over (order by m desc) <= {n} then '{high}' else '{low}' end
      as RANKING_CATEGORY, rank() over (order by m desc) as RANK_TOP from g qualify rank() over (order by m desc) <= {n} or rank() over (order by m) <= {n}) q"""


def _deposit_rank(n: int) -> str:
    return _ranked(_FACTS + "one as (select 1)", f"count(ACCOUNT_NO) as DEPOSIT_ACCOUNTS, {_sum0('CURRENT_BALANCE')} as TOTAL_DEPOSITS, {_AVG} as AVG_RATE",
                   "sum(coalesce(CURRENT_BALANCE, 0))", f"acc f left join {DIM} d on f.BRANCH_CODE = d.BRANCH_CODE where {_LAST} and ACCOUNT_CATEGORY = 'DEPOSIT'",
                   n, "TOP", "BOTTOM")


@query("q_06_branches_by_deposits", _deposit_rank(5), f"{ACCOUNT_SOURCES} network", 4)
def branches_by_deposits(t):
    return dashboards.branches_by_deposits(accounts_fact(t), branches.load_hierarchy(t("network")), n=5)


@query("q_07_branches_by_advances", _ranked(
    _FACTS + "one as (select 1)", f"count(ACCOUNT_NO) as LOAN_ACCOUNTS, {_sum0('OUTSTANDING')} as TOTAL_ADVANCES, {_AVG} as AVG_RATE",
    "sum(coalesce(OUTSTANDING, 0))", f"acc f left join {DIM} d on f.BRANCH_CODE = d.BRANCH_CODE where {_LAST} and ACCOUNT_CATEGORY in ('LOAN', 'CC_OD')",
    5, "TOP", "BOTTOM"), f"{ACCOUNT_SOURCES} network", 4)
def branches_by_advances(t):
    return dashboards.branches_by_advances(accounts_fact(t), branches.load_hierarchy(t("network")), n=5)


@query("q_08_branches_by_npa", _ranked(
    f"with {_RISKS}", f"""count(ACCOUNT_NO) as NPA_ACCOUNTS, {_sum0('BALANCE_OUTSTANDING')} as NPA_OUTSTANDING, {_sum0('INCA')} as TOTAL_INCA,
    {_sum0('UIPY')} as TOTAL_UIPY, count(*) filter (where NPA_CLASSIFICATION = 'SUB_STANDARD') as SUB_STD_COUNT,
    count(*) filter (where NPA_CLASSIFICATION = 'DOUBTFUL') as DOUBTFUL_COUNT, count(*) filter (where NPA_CLASSIFICATION = 'LOSS') as LOSS_COUNT""",
    "sum(coalesce(BALANCE_OUTSTANDING, 0))", f"risks f left join {DIM} d on f.BRANCH_CODE = d.BRANCH_CODE where {_LAST_RISK} and IS_CONFIRMED_NPA",
    5, "TOP_NPA", "LEAST_NPA"), f"{RISK_SOURCES} network", 4)
def branches_by_npa(t):
    return dashboards.branches_by_npa(risk_fact(t), branches.load_hierarchy(t("network")), n=5)


@query("q_09_branches_per_office", f"select REGIONAL_OFFICE_CODE, REGIONAL_OFFICE_NAME, count(*) as BRANCH_COUNT from {DIM} d group by 1, 2", "network")
def branches_per_office(t):
    return branches.branches_per_office(branches.load_hierarchy(t("network")))


_NPA_SUM = f"sum({o.comma_free('OUTSTANDING')})"


@query("q_10_notifications", f"""select 'High NPA Alert' as kind, branch_code, substring(branch_name, 1, 15) as branch_name, amount, cast(null as bigint) as accounts from (
    select BRANCH_CODE as branch_code, coalesce((select min(BRANCH_NAME) from loans l where l.BRANCH_CODE = npa.BRANCH_CODE), BRANCH_CODE) as branch_name,
    {o.r2(_NPA_SUM)} as amount from npa group by BRANCH_CODE order by amount desc, BRANCH_CODE limit 1) w
    union all select 'Account Closures', 'ALL', null, null, count(*) from closed""", "npa loans closed")
def notifications(t):
    return reports.notifications(t("npa"), t("loans"), t("closed"))


@query("q_11_branch_lists", """select distinct trim(BRANCH_CODE) as code, coalesce(nullif(trim(BRANCH_NAME), ''), 'Unknown') as name,
    coalesce(trim(REGIONAL_OFFICE), '') as region from network where BRANCH_CODE <> ''""", "network")
def branch_lists(t):
    return branches.branch_list(t("network"))


_BAL = f"sum({o.comma_free('CURRBAL')})"
_STATUS = """case STATUS when '00' then 'Open' when '01' then 'Dormant' when '02' then 'Unclaimed' when '03' then 'Inoperative' when '07' then 'Closed'
    when '11' then 'Inactive' else 'Others' end"""


@query("q_12_master_stats", f"""select 'deposits' as section, {_STATUS} as label, count(*) as accounts, {o.r2(_BAL)} as amount from deposit_shadow group by 2
    union all select 'loans', substring(s, 1, 25), n, v from (select coalesce(SCHEMEDESC, 'Unknown Scheme') as s, count(*) as n, {o.r2(f'abs({_BAL})')} as v from loan_shadow group by 1) g
    union all select 'deposits total', '', count(*), {o.r2(_BAL)} from deposit_shadow union all select 'loans total', '', count(*), {o.r2(f'abs({_BAL})')} from loan_shadow""",
       "deposit_shadow loan_shadow")
def master_stats(t):
    return reports.master_stats(t("deposit_shadow"), t("loan_shadow"))


@query("q_13_top_deposit_branches", f"""select substring(BRANCH_NAME, 1, 15) as name, {o.r2('coalesce(v, 0)')} as deposits from (select BRANCH_NAME,
    sum({o.as_printed('CURRENT_BALANCE')}) as v from deposits where {DAY} = (select max({DAY}) from deposits) group by 1
    order by v desc nulls last, BRANCH_NAME limit 10) g""", "deposits")
def top_deposit_branches(t):
    return reports.top_deposit_branches(t("deposits"))


def _moves(table: str, where: str = "true") -> str:
    return f"""select substring(coalesce(REGIONAL_OFFICE, 'Unknown Region'), 1, 15) as name, count(*) as value, count(*) filter (where PRODUCT like '6%') as loan_accounts,
      count(*) filter (where PRODUCT not like '6%') as deposit_accounts from {table} a left join network n on a.BRANCH_CODE = n.BRANCH_CODE where {where} group by REGIONAL_OFFICE"""


@query("q_14_opened_by_branch", _moves("opened"), "opened network")
def opened_by_branch(t):
    return reports.movements_by_branch(t("opened"), "OPENED_DATE", t("network"))


@query("q_15_closed_by_branch", _moves("closed", f"{o.day('CLOSED_DATE')} >= (select max({o.day('CLOSED_DATE')}) from closed) - 365"), "closed network")
def closed_by_branch(t):
    return reports.movements_by_branch(t("closed"), "CLOSED_DATE", t("network"), period="1Y")


def _accounts_side(table: str, account: str) -> str:
    return f"""(select coalesce(REGIONAL_OFFICE, 'Unknown Region') as name, count(distinct {account}) as c from {table} a left join network n on a.BRANCH_CODE = n.BRANCH_CODE
      where {DAY} between date '1996-01-01' and date '2025-12-31' group by 1)"""


@query("q_16_accounts_by_branch", f"""select substring(coalesce(d.name, l.name), 1, 15) as name, coalesce(d.c, 0) + coalesce(l.c, 0) as value, coalesce(l.c, 0) as loan_accounts,
    coalesce(d.c, 0) as deposit_accounts from {_accounts_side('deposits', 'ACCOUNT_NUMBER')} d full join {_accounts_side('loan_detail', 'ACCOUNT')} l on d.name = l.name""",
       "deposits loan_detail network")
def accounts_by_branch(t):
    return reports.accounts_by_branch(t("deposits"), t("loan_detail"), t("network"), start="1996-01-01", end="2025-12-31")


_REGION = "coalesce(REGIONAL_OFFICE, 'Unknown Region')"


@query("q_17_shadow_deposits", f"""select {_REGION} as name, {o.r2(_BAL)} as value, count(*) as account_count from deposit_shadow s left join network n
    on s.BRNO = n.BRANCH_CODE group by 1""", "deposit_shadow network")
def shadow_deposits(t):
    return reports.shadow_deposits_by_branch(t("deposit_shadow"), t("network"))


_KPI = f"""select (select {o.r2('sum(' + o.comma_free('CURRENT_BALANCE') + ')')} from (select CURRENT_BALANCE from deposit_series where {{dep}}
    qualify row_number() over (partition by BRANCH_CODE, ACCOUNT_NUMBER order by LOAD_SEQ desc) = 1) x) as total_deposits,
    (select {o.r2('sum(' + o.comma_free('DR_BALANCE') + ')')} from loan_detail where {{loan}}) as total_loans,
    (select {o.r2(_NPA_SUM)} from npa where {{npa}}) as total_npa, (select count(distinct BRANCH_CODE) from deposit_series where {{dep}}) as branches_reporting"""
_RANGE = f"{DAY} between date '1995-01-01' and date '2001-12-31'"


@query("q_18_kpi_summary", _KPI.format(dep=_RANGE, loan=_RANGE, npa=_RANGE), "deposit_series loan_detail npa")
def kpi_summary(t):
    return reports.kpi_summary(t("deposit_series"), t("loan_detail"), t("npa"), ["LOAD_SEQ"], start="1995-01-01", end="2001-12-31")


_ZERO = "sum(cast(coalesce(nullif({}, ''), '0') as double))"
_CR, _DR = _ZERO.format("CR_BALANCE"), _ZERO.format("DR_BALANCE")


@query("q_19_kpi_counts", f"""select (select count(*) from opened) as total_opened, (select count(*) from closed) as total_closed, {o.r2(_CR + ' - ' + _DR)} as total_gl_balance,
    {o.r2(_CR)} as total_cr_balance, {o.r2(_DR)} as total_dr_balance, (select count(*) from loan_detail) as total_loans, (select count(*) from deposits) as total_deposits,
    (select count(*) from members) as total_members from gl_detail""", "opened closed gl_detail loan_detail deposits members")
def kpi_counts(t):
    return reports.kpi_counts(t("opened"), t("closed"), t("gl_detail"), t("loan_detail"), t("deposits"), t("members"))


@query("q_20_gl_volume", f"""select LEDGER_NAME || ' (' || BRANCH_NAME || ')' as name, {o.r2('v')} as value from (select LEDGER_NAME, BRANCH_NAME,
    round(sum(cast(coalesce(nullif(CR_BALANCE, ''), '0') as double) + cast(coalesce(nullif(DR_BALANCE, ''), '0') as double)), 2) as v from gl_detail
    group by 1, 2 order by v desc, 1, 2 limit 6) g""", "gl_detail")
def gl_volume(t):
    return reports.gl_volume(t("gl_detail"))


@query("q_21_deposits_by_type", """select ACCOUNT_TYPE as name, count(*) as value from deposits where ACCOUNT_TYPE <> '' group by 1 order by 2 desc, 1 limit 8""", "deposits")
def deposits_by_type(t):
    return reports.deposits_by_type(t("deposits"))


_NUM = "coalesce(try_cast(replace({}, ',', '') as double), 0)"


@query("q_22_product_transfers", f"""select substring(PROD_DESC, 1, 20) as name, round(c, 2) as credit, round(x, 2) as debit from (select PROD_DESC, sum({_NUM.format('TRANSFER_CREDIT')}) as c,
    sum({_NUM.format('TRANSFER_DEBIT')}) as x from flows where PROD_DESC <> '' group by 1 order by c desc, 1 limit 6) g""", "flows")
def product_transfers(t):
    return reports.product_transfers(t("flows"))


@query("q_23_glcc_largest", f"""select name, accounts, amount from (select substring(NAME, 1, 25) as name, try_cast(ACT_TOTAL as bigint) as accounts,
    {o.r2("replace(replace(TOTAL_AMOUNT, ',', ''), '-', '')")} as amount, NAME as n, GL_CLASS_CODE, BRANCH_CODE from gl_totals where NAME <> '' and TOTAL_AMOUNT <> ''
    order by amount desc, n, GL_CLASS_CODE, BRANCH_CODE, accounts limit 8) g""", "gl_totals")
def glcc_largest(t):
    return reports.glcc_largest(t("gl_totals"))


@query("q_24_daybook_by_type", f"""select substring(TXN_TYPE, 1, 22) as name, count(*) as count, {o.r2('sum(' + _NUM.format('DEBIT') + ')')} as amount from daybook
    where TXN_TYPE <> '' group by TXN_TYPE order by 2 desc, TXN_TYPE limit 6""", "daybook")
def daybook_by_type(t):
    return reports.daybook_by_type(t("daybook"))


def _dash(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '-')"


@query("q_25_exceptions_list", f"""select ACCOUNT_NO as account_no, AMOUNT as amount, {_dash('CUSTOMER_NAME')} as customer_name, {_dash('ERROR_DESC')} as error_desc,
    OUTSTANDING as outstanding from breaches order by 1, 2, 3, 4, 5 limit 10""", "breaches")
def exceptions_list(t):
    return reports.exceptions_list(t("breaches"))


@query("q_26_drawing_power_list", """select CUSTOMER_NAME as customer_name, ACCOUNT_NO as account_no, OUTSTANDING as outstanding, DRAWING_POWER as drawing_power,
    IRREGULARITY as irregularity from drawing order by 1, 2, 3, 4, 5 limit 10""", "drawing")
def drawing_power_list(t):
    return reports.drawing_power_list(t("drawing"))


@query("q_27_alterations_list", f"""select ACCOUNT_NO as account_no, CUSTOMER_NAME as customer_name, INT_RATE_OLD as old_rate, INT_RATE_NEW as new_rate, {o.iso(DAY)} as date,
    coalesce(nullif(BRANCH_NAME, ''), 'N/A') as branch_name, coalesce(nullif(ACCT_TYPE_OLD, ''), 'N/A') as old_type, coalesce(nullif(ACCT_TYPE_NEW, ''), 'N/A') as new_type
    from alterations order by date desc, account_no limit 10""", "alterations")
def alterations_list(t):
    return reports.alterations_list(t("alterations"))


@query("q_28_deposit_balance_list", f"""select ACCOUNT_NUMBER as account_no, {_dash('CUSTOMER_NAME')} as customer_name, {_dash('ACCOUNT_TYPE')} as account_type,
    CURRENT_BALANCE as current_balance, INT_RATE as int_rate, {_dash('STATUS')} as status, {_dash('JOINT_HOLD_FLAG')} as joint from deposits
    where CURRENT_BALANCE <> '' order by 1 limit 10""", "deposits")
def deposit_balance_list(t):
    return reports.deposit_balance_list(t("deposits"))


@query("q_29_rate_exceptions_list", """select ACCOUNT_NUMBER as account_no, CUSTOMER_NAME as customer_name, SANCTION_AMOUNT as sanction_amount, PRODUCT_INT_RATE as product_rate,
    EFFECTIVE_INT_RATE as effective_rate from rates""", "rates")
def rate_exceptions_list(t):
    return reports.rate_exceptions_list(t("rates"))


_FIG = "coalesce(try_cast(nullif({}, '') as double), 0)"


@query("q_30_least_active_users", f"""select trim(original_id) as id, {_FIG.format('NO_OF_TXNS_DEBIT')} as debit, {_FIG.format('NO_OF_TXNS_CREDIT')} as credit,
    {_FIG.format('MEMO_HITS')} as hits from users where original_id <> '' order by debit + credit, id limit 10""", "users")
def least_active_users(t):
    return reports.least_active_users(t("users"))


@query("q_31_loan_npa_totals", f"""select {o.r2('abs(sum(' + o.as_printed('DR_BALANCE') + '))')} as total_loans, (select {o.r2(f'abs({_NPA_SUM})')} from npa) as total_npa from loan_detail""",
       "loan_detail npa")
def loan_npa_totals(t):
    return reports.loan_npa_totals(t("loan_detail"), t("npa"))


@query("q_32_npa_by_branch", f"""select substring({_REGION}, 1, 15) as name, {o.r2(_NPA_SUM)} as npa from npa a left join network n on a.BRANCH_CODE = n.BRANCH_CODE
    where {DAY} >= (select max({DAY}) from npa) - 180 and a.BRANCH_CODE <> '' group by REGIONAL_OFFICE""", "npa network")
def npa_by_branch(t):
    return reports.npa_by_branch(t("npa"), t("network"), period="6M")


@query("q_33_network_listing", """select HEAD_OFFICE, REGIONAL_OFFICE, BRANCH_NAME, DISTRICT, ADDRESS, CONTACT_NO from network""", "network")
def network_listing(t):
    return branches.network_listing(t("network"))


@query("q_34_shadow_loans", f"""select substring({_REGION}, 1, 15) as name, {o.r2(_BAL)} as loans from loan_shadow s left join network n on s.BRNO = n.BRANCH_CODE
    group by REGIONAL_OFFICE""", "loan_shadow network")
def shadow_loans(t):
    return reports.shadow_loans_by_branch(t("loan_shadow"), t("network"))


@query("q_35_loan_types", f"""select substring(PRODUCT_NAME, 1, 30) as name, PRODUCT_NAME as raw_name, {o.r2('v')} as value from (select PRODUCT_NAME,
    coalesce(sum({o.as_printed('DR_BALANCE')}), 0) as v from loan_detail where {DAY} >= (select max({DAY}) from loan_detail) - 365 group by 1 order by v desc, 1 limit 10) g""", "loan_detail")
def loan_types(t):
    return reports.loan_types(t("loan_detail"), period="1Y")


@query("q_36_loan_type_branches", f"""select substring(BRANCH_NAME, 1, 15) as name, {o.r2('coalesce(sum(' + o.as_printed('DR_BALANCE') + '), 0)')} as value from loan_detail
    where {DAY} >= (select max({DAY}) from loan_detail) - 365 and PRODUCT_NAME = '1-URGENT' group by BRANCH_NAME""", "loan_detail")
def loan_type_branches(t):
    return reports.loan_type_branches(t("loan_detail"), "1-URGENT", period="1Y")


_SERIES = """(select {d} as day, sum(try_cast({c} as double)) as v from {t} where {d} >= (select max({d}) from {t}) - 90 group by 1)"""


@query("q_37_trend", f"""with a as {_SERIES.format(d=DAY, c='DR_BALANCE', t='loan_detail')}, b as {_SERIES.format(d=DAY, c='CURRENT_BALANCE', t='deposit_series')},
    m as (select coalesce(a.day, b.day) as day, coalesce(a.v, 0) as l, coalesce(b.v, 0) as p from a full join b on a.day = b.day),
    c as (select cast(unnest(generate_series((select max(day) from m) - interval 89 day, (select max(day) from m), interval 1 day)) as date) as day)
    select cast(c.day as varchar) as name, {o.r2('coalesce(l, 0)')} as loans, {o.r2('coalesce(p, 0)')} as deposits from c left join m on c.day = m.day""", "loan_detail deposit_series")
def trend(t):
    return reports.trend(t("loan_detail"), t("deposit_series"), period="90D")


_PROFILE_COLUMNS = "CUSTOMER_NAME, ACCOUNT_TYPE, CURRENT_BALANCE, INT_RATE, TERM, BRANCH_CODE"


def _metric(c: str) -> str:
    n = f"try_cast(nullif(trim(replace(\"{c}\", ',', '')), '-') as double)"
    return f"select 'sum' as part, '{c}' as name, {o.r2(f'sum({n})')} as total, {o.r2(f'avg({n})')} as average from p having count({n}) > count(*) * 0.1"


_DEPOSIT_KEYS = "ACCOUNT_NUMBER ACCOUNT_TYPE CUSTOMER_NAME REPORT_ID BRANCH_CODE BRANCH_NAME PROC_DATE".split()
_DEPOSIT_FIGURES = "AVAILABLE_BALANCE UNCLEARED_BALANCE CURRENT_BALANCE LIMIT TERM INT_RATE STATUS JOINT_HOLD_FLAG LOAD_SEQ".split()
_PROFILED = ", ".join(f'cast("{c}" as varchar) as "{c}"' for c in [*_DEPOSIT_KEYS, *_DEPOSIT_FIGURES])
_PLAIN = "trim(AVAILABLE_BALANCE)"


@query("q_38_report_profile", f"""with p as (select {_PROFILED} from deposits) select 'rows' as part, '' as name, cast(count(*) as double) as total, 0.0::double as average from p
    {' '.join(f'union all select * from ({_metric(c)}) m' for c in _DEPOSIT_FIGURES)}
    {' '.join(f"union all select * from (select 'distinct', '{c}', cast(count(distinct trim({c})) as double), 0.0 from p where {c} <> '' having count(*) > 0) d" for c in _DEPOSIT_KEYS)}
    union all select 'value', {_PLAIN}, cast(count(*) as double), 0.0 from p where regexp_replace({_PLAIN}, '[-=>*#_| ]', '', 'g') <> '' group by {_PLAIN}""", "deposits")
def report_profile(t):
    return reports.report_profile(t("deposits"))


@query("q_39_account_metrics", f"""select (select count(*) from opened where {o.day('OPENED_DATE')} >= (select max({o.day('OPENED_DATE')}) from opened) - 90) as opened,
    (select count(*) from closed where {o.day('CLOSED_DATE')} >= (select max({o.day('CLOSED_DATE')}) from closed) - 90) as closed,
    (select count(distinct ACCOUNT_NUMBER) from deposits where {DAY} = (select max({DAY}) from deposits)) +
    (select count(distinct ACCOUNT) from loan_detail where {DAY} = (select max({DAY}) from loan_detail)) as total""", "opened closed deposits loan_detail")
def account_metrics(t):
    return reports.account_metrics(t("deposits"), t("loan_detail"), t("opened"), t("closed"), period="90D")


_KEY = "try_cast(replace(replace(coalesce(OUTSTANDING, '0'), ',', ''), '₹', '') as double)"


@query("q_40_explorer_page", f"""select DESCRIPT, OUTSTANDING, BRANCH_CODE, BRANCH_NAME, PROC_DATE, count(*) over () as total_records from npa
    where DESCRIPT ilike '%urgent%' or OUTSTANDING ilike '%urgent%' or BRANCH_CODE ilike '%urgent%' or BRANCH_NAME ilike '%urgent%' or PROC_DATE ilike '%urgent%'
    order by {_KEY}, DESCRIPT, OUTSTANDING, BRANCH_CODE, BRANCH_NAME, PROC_DATE limit 50 offset 100""", "npa")
def explorer_page(t):
    return reports.explorer_page(t("npa"), text="urgent", number=3)


@query("q_41_auto_metrics", f"""select BRANCH_CODE, max(BRANCH_NAME) as BRANCH_NAME, 'DR_BALANCE' as metric, {o.r2("sum(try_cast(replace(DR_BALANCE, ',', '') as double))")} as total
    from loan_detail where {DAY} >= (select max({DAY}) from loan_detail) - 365 group by 1""", "loan_detail")
def auto_metrics(t):
    return reports.auto_metrics(t("loan_detail").drop("ACCOUNT"), period="1Y")


@query("q_42_npa_by_facility", f"""select coalesce(nullif(DESCRIPT, ''), 'Unknown') as category, {o.r2(_NPA_SUM)} as amount,
    {o.r2(f"{_NPA_SUM} / (select {_NPA_SUM} from npa where {DAY} >= (select max({DAY}) from npa) - 365) * 100")} as pct from npa
    where {DAY} >= (select max({DAY}) from npa) - 365 group by DESCRIPT""", "npa")
def npa_by_facility(t):
    return reports.npa_by_facility(t("npa"), period="1Y")


@query("q_43_ageing_exceptions", f"""select 'BGL Aging Exceptions' as title, count(*) as count from bgl_ageing where {DAY} >= (select max({DAY}) from bgl_ageing) - 365""", "bgl_ageing")
def ageing_exceptions(t):
    return reports.ageing_exceptions(t("bgl_ageing"), period="1Y")


_TOT = f"sum({o.comma_free('TOTAL_AMOUNT')})"
_IRR = f"sum({o.comma_free('IRREGULARITY')})"


@query("q_44_loans_dashboard", f"""with y as (select * from npa where {_RANGE}) select 'overview' as section, 'total_loans' as name, {o.r2(_TOT)} as value from loan_totals where {_RANGE}
    union all select 'overview', 'total_npa', {o.r2(_NPA_SUM)} from y union all select 'overview', 'total_irregular', 0.0::double
    union all select 'products', NAME, {o.r2(_TOT)} from loan_totals where {_RANGE} group by NAME
    union all select 'branches', BRANCH_NAME, {o.r2(_TOT)} from loan_totals where {_RANGE} group by BRANCH_NAME
    union all select 'branch_npa', coalesce((select min(BRANCH_NAME) from loans b where b.BRANCH_CODE = y.BRANCH_CODE), y.BRANCH_CODE), {o.r2(_NPA_SUM)} from y group by y.BRANCH_CODE""",
       "loan_totals npa irregular loans")
def loans_dashboard(t):
    return reports.loans_dashboard(t("loan_totals"), t("npa"), t("irregular"), t("loans"), start="1995-01-01", end="2001-12-31")


_AVL = o.comma_free("AVAILABLE_BALANCE")
_CASA = "(ACCOUNT_TYPE ilike 'SB%' or ACCOUNT_TYPE ilike 'CA%' or ACCOUNT_TYPE ilike 'CURRENT%')"
_TERM = "(ACCOUNT_TYPE ilike '%TDR%' or ACCOUNT_TYPE ilike 'RD%' or ACCOUNT_TYPE ilike '%FDR%')"


@query("q_45_deposits_dashboard", f"""select 'overview' as section, 'total_deposits' as name, {o.r2(f'sum({_AVL})')} as value from deposits
    union all select 'overview', 'casa_deposits', {o.r2(f'sum(case when {_CASA} then {_AVL} else 0 end)')} from deposits
    union all select 'overview', 'term_deposits', {o.r2(f'sum(case when {_TERM} then {_AVL} else 0 end)')} from deposits
    union all select 'products', coalesce(ACCOUNT_TYPE, 'Other'), {o.r2(f'sum({_AVL})')} from deposits group by ACCOUNT_TYPE
    union all select 'branches', BRANCH_NAME, {o.r2(f'sum({_AVL})')} from deposits group by BRANCH_NAME""", "deposits")
def deposits_dashboard(t):
    return reports.deposits_dashboard(t("deposits"))


@query("q_46_npa_trend", f"""select cast(a.day as varchar) as name, {o.r2('case when coalesce(b.v, 0) > 0 then a.v / b.v * 100 else 0 end')} as value, {o.r2('a.v / 1e5')} as npa_lakhs from
    (select {DAY} as day, {_NPA_SUM} as v from npa where {_RANGE} group by 1) a left join (select {DAY} as day, {_TOT} as v from loan_totals group by 1) b on a.day = b.day""", "npa loan_totals")
def npa_trend(t):
    return reports.npa_trend(t("npa"), t("loan_totals"), start="1995-01-01", end="2001-12-31")


_LENT = f"(select BRANCH_NAME as name, {_TOT} as v from loan_totals group by 1)"
_BAD = f"(select BRANCH_NAME as name, {_NPA_SUM} as v from npa group by 1)"


@query("q_47_npa_ratio", f"""select a.name, {o.r2('case when a.v > 0 then coalesce(b.v, 0) / a.v * 100 else 0 end')} as value from {_LENT} a left join {_BAD} b on a.name = b.name
    union all select 'ALL', {o.r2(f'(select sum(v) from {_BAD} y) / (select sum(v) from {_LENT} x) * 100')}""", "loan_totals npa")
def npa_ratio(t):
    from ledgerlake.functions import numbers

    lent = t("loan_totals").groupBy(F.col("BRANCH_NAME").alias("name")).agg(numbers.sum_comma_free("TOTAL_AMOUNT").alias("value"))
    bad = t("npa").groupBy(F.col("BRANCH_NAME").alias("name")).agg(numbers.sum_comma_free("OUTSTANDING").alias("value"))
    return reports.npa_ratio(lent, bad)


@query("q_48_casa_ratio", f"select {o.r2(f'sum(case when {_CASA} then {_AVL} end) / sum({_AVL}) * 100', 1)} as casa_ratio from deposits", "deposits")
def casa_ratio(t):
    return reports.casa_ratio(t("deposits"))


_SHARE = "coalesce(abs(try_cast(replace(OUTSTANDING, ',', '') as double)), 0)"


@query("q_49_shares", f"""select ACCOUNT_NO as name, {o.r2(_SHARE)} as value, {o.r2(f'{_SHARE} / sum({_SHARE}) over () * 100')} as share from loans where ACCOUNT_NO ilike '%99%'""", "loans")
def shares(t):
    return reports.shares(t("loans"), "ACCOUNT_NO", "OUTSTANDING", "99")


@query("q_50_directory", """select coalesce(REGIONAL_OFFICE, 'Unassigned') as office, BRANCH_NAME, BRANCH_CODE, DISTRICT from network
    where BRANCH_NAME ilike '%1%' or REGIONAL_OFFICE ilike '%1%'""", "network")
def directory(t):
    return branches.directory(t("network"), "1")


@query("q_51_shadow_inspection", f"""select 'deposits rows' as section, '' as label, count(*) as accounts, {o.r2(_BAL)} as amount from deposit_shadow
    union all select 'deposits status', STATUS, count(*), {o.r2(_BAL)} from deposit_shadow group by STATUS union all select 'loans rows', '', count(*), {o.r2(_BAL)} from loan_shadow
    union all select 'loans status', STATUS, count(*), {o.r2(_BAL)} from loan_shadow group by STATUS
    union all select 'loans scheme', coalesce(SCHEMEDESC, 'Unknown Scheme'), count(*), {o.r2(_BAL)} from loan_shadow group by 2""", "deposit_shadow loan_shadow")
def shadow_inspection(t):
    return reports.shadow_inspection(t("deposit_shadow"), t("loan_shadow"))


@query("src_22_row_counts", """select 'npa' as table_name, count(*) as records from npa where BRANCH_CODE = '00007' union all select 'deposits', count(*) from deposits where BRANCH_CODE = '00007'
    union all select 'deposit_shadow', count(*) from deposit_shadow""", "npa deposits deposit_shadow")
def row_counts(t):
    return staging.row_counts({n: t(n) for n in ("npa", "deposits", "deposit_shadow")}, "00007")
