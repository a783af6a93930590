"""Scopes, joins, aggregates, windows, sorts and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import cleanse, labels, numbers
from ledgerlake.operators import explore, joining, profiling, ranking, scope, security
from ledgerlake.plans import branches, dashboards, risk, warehouse

from . import oracle as o
from .loads import ACCOUNT_SOURCES, ACCOUNTS, AUDIT, AUDIT_SOURCES, DIM, RISK_SOURCES, fact, risk_upto, staged
from .registry import query

DAY = o.day("PROC_DATE")

# ---------------------------------------------------------------- scopes


@query("flt_01_branch_scope", """select 'REGION' as scope, count(*) as rows from loan_detail where BRANCH_CODE in (
    select BRANCH_CODE from network where REGIONAL_OFFICE = 'Rail Head Complex') union all
    select 'BRANCH', count(*) from loan_detail where BRANCH_CODE = '00007' union all select 'ALL', count(*) from loan_detail""", "loan_detail network")
def branch_scope(t):
    rows, network = t("loan_detail"), t("network")

    def count(name, wanted):
        return scope.in_branch(rows, wanted, network).agg(F.count("*").alias("rows")).select(F.lit(name).alias("scope"), "rows")

    return count("REGION", "REGION:Rail Head Complex").unionByName(count("BRANCH", "00007")).unionByName(count("ALL", "ALL"))


_PERIODS = ("7D", "15D", "30D", "90D", "6M", "1Y", "YTD")


@query("flt_02_period_scope", " union all ".join(
    f"select '{p}' as period, count(*) as rows from opened where {o.day('OPENED_DATE')} >= (select max({o.day('OPENED_DATE')}) from opened) - {scope.PERIOD_DAYS[p]}"
    for p in _PERIODS) + f""" union all select 'RANGE', count(*) from opened where {o.day('OPENED_DATE')} between date '1996-01-01' and date '1996-12-31'
    union all select 'DAY', count(*) from opened where {o.day('OPENED_DATE')} = date '1997-05-28' union all select 'ISO', count(*) from opened
    where {o.day('OPENED_DATE')} = date '1998-10-03' union all select 'OTHER', count(*) from opened""", "opened")
def period_scope(t):
    rows = t("opened")

    def count(name, **period):
        got = scope.in_period(rows, column="OPENED_DATE", **period).agg(F.count("*").alias("rows"))
        return got.select(F.lit(name).alias("period"), "rows")

    out = count("RANGE", start="1996-01-01", end="1996-12-31")
    for part in [count(p, period=p) for p in _PERIODS] + [
            count("DAY", start="1997-05-28"), count("ISO", period="1998-10-03"), count("OTHER", period="all_time")]:
        out = out.unionByName(part)
    return out


@query("flt_03_newest_snapshot", f"""select BRANCH_CODE, count(*) as rows from deposits where {DAY} = (select max({DAY}) from deposits) group by 1""", "deposits")
def newest_snapshot(t):
    rows = scope.in_period(t("deposits"), "ALL", table="DEPOSITS_BALANCE_FILE_DEPD0586")
    return rows.groupBy("BRANCH_CODE").agg(F.count("*").alias("rows"))


@query("flt_04_report_day", f"select count(*) as accounts from {ACCOUNTS} a where SNAPSHOT_DATE = (select max(SNAPSHOT_DATE) from {ACCOUNTS} b)", ACCOUNT_SOURCES)
def report_day(t):
    rows = accounts_fact(t)
    return rows.filter(F.col("SNAPSHOT_DATE") == scope.report_day(rows)).agg(F.count("*").alias("accounts"))


@query("flt_05_key_present", "select count(*) as rows from users where NO_OF_TXNS_CREDIT is not null and trim(NO_OF_TXNS_CREDIT) <> ''", "users")
def key_present(t):
    return t("users").filter(scope.key_present("NO_OF_TXNS_CREDIT")).agg(F.count("*").alias("rows"))


@query("flt_07_search", "select p_partkey, p_name, p_brand, p_type from part where p_name ilike '%red%' or p_brand ilike '%red%' or p_type ilike '%red%'")
def search(t):
    return scope.search(t.given("part").select("p_partkey", "p_name", "p_brand", "p_type"), "RED")


_USERS = ("ho_admin", "ro_railhead", "branch_parade", "branch_left", "nobody")
_SEES = f"""(exists (select 1 from access u where u.USER_LOGIN = w.login and ACCESS_ROLE = 'HO' and IS_ACTIVE)
    or exists (select 1 from access u join {DIM} d on d.REGIONAL_OFFICE_CODE = u.REGIONAL_OFFICE_CODE where u.USER_LOGIN = w.login and ACCESS_ROLE = 'RO'
      and u.IS_ACTIVE and d.BRANCH_CODE = l.BRANCH_CODE)
    or exists (select 1 from access u where u.USER_LOGIN = w.login and ACCESS_ROLE = 'BRANCH' and u.IS_ACTIVE and u.BRANCH_CODE = l.BRANCH_CODE))"""


@query("flt_08_row_security", f"""select w.login, sum(case when {_SEES} then l.n else 0 end)::bigint as rows from
    (select BRANCH_CODE, count(*) as n from loan_detail group by 1) l, (select unnest({list(_USERS)!r}) as login) w group by 1
    union all select 'none', count(*) from loan_detail""", "loan_detail network access")
def row_security(t):
    rows, hierarchy, access = t("loan_detail"), branches.load_hierarchy(t("network")), t("access")

    def count(user):
        seen = security.secure(rows, access, hierarchy, user).agg(F.count("*").alias("rows"))
        return seen.select(F.lit(user or "none").alias("login"), "rows")

    out = count(None)
    for user in _USERS:
        out = out.unionByName(count(user))
    return out


@query("udf_02_security_predicate", f"""select BRANCH_CODE from {DIM} d where REGIONAL_OFFICE_CODE = 'RO02' union select '00003'""", "network access")
def security_predicate(t):
    return security.allowed_branches(t("access"), branches.load_hierarchy(t("network")), "ro_railhead")


@query("flt_12_severity_flags", f"""select count(*) filter (where SEVERITY in ('HIGH', 'CRITICAL')) as critical, count(*) as rows from {AUDIT} a""", AUDIT_SOURCES)
def severity_flags(t):
    from ledgerlake.plans import audit

    return audit.audit_exceptions(staged(t, *AUDIT_SOURCES.split())).agg(
        F.count_if(F.col("SEVERITY").isin("HIGH", "CRITICAL")).alias("critical"), F.count("*").alias("rows"))


def accounts_fact(t):
    return fact(t, warehouse.ACCOUNTS)


def risk_fact(t):
    return fact(t, warehouse.RISK)


RISK = risk_upto("step_g")


@query("prj_07_category_volume", f"""select ACCOUNT_NO, ACCOUNT_CATEGORY, cast(case ACCOUNT_CATEGORY when 'DEPOSIT' then coalesce(CURRENT_BALANCE, 0)
    when 'LOAN' then coalesce(OUTSTANDING, 0) else abs(coalesce(CURRENT_BALANCE, 0)) end as double) as volume from {ACCOUNTS} a""", ACCOUNT_SOURCES)
def category_volume(t):
    return accounts_fact(t).select("ACCOUNT_NO", "ACCOUNT_CATEGORY", labels.category_volume().alias("volume"))


@query("prj_08_book_balance", f"""select ACCOUNT_NO, ACCOUNT_CATEGORY, cast(case ACCOUNT_CATEGORY when 'DEPOSIT' then coalesce(CURRENT_BALANCE, 0)
    else coalesce(OUTSTANDING, abs(CURRENT_BALANCE), 0) end as double) as balance from {ACCOUNTS} a""", ACCOUNT_SOURCES)
def book_balance(t):
    return accounts_fact(t).select("ACCOUNT_NO", "ACCOUNT_CATEGORY", labels.book_balance().alias("balance"))


# ---------------------------------------------------------------- joins

@query("jn_02_fact_to_branch", f"""select a.ACCOUNT_NO, a.ACCOUNT_CATEGORY, d.BRANCH_NAME, d.REGIONAL_OFFICE_NAME from {ACCOUNTS} a
    left join {DIM} d on a.BRANCH_CODE = d.BRANCH_CODE""", f"{ACCOUNT_SOURCES} network")
def fact_to_branch(t):
    names = branches.load_hierarchy(t("network")).select("BRANCH_CODE", "BRANCH_NAME", "REGIONAL_OFFICE_NAME")
    return accounts_fact(t).join(names, "BRANCH_CODE", "left").select("ACCOUNT_NO", "ACCOUNT_CATEGORY", "BRANCH_NAME", "REGIONAL_OFFICE_NAME")


@query("jn_03_staging_to_region", """select coalesce(n.REGIONAL_OFFICE, 'Unknown Region') as group_name, count(*) as accounts from deposit_shadow s
    left join network n on s.BRNO = n.BRANCH_CODE group by 1""", "deposit_shadow network")
def staging_to_region(t):
    return scope.group_label(t("deposit_shadow"), "ALL", t("network"), "BRNO").groupBy("group_name").agg(F.count("*").alias("accounts"))


@query("jn_04_full_outer_counts", """select coalesce(d.n, l.n) as name, coalesce(d.c, 0) as deposits, coalesce(l.c, 0) as loans from
    (select BRANCH_NAME as n, count(distinct ACCOUNT_NUMBER) as c from deposits group by 1) d full join
    (select BRANCH_NAME as n, count(distinct ACCOUNT) as c from loan_detail group by 1) l on d.n = l.n""", "deposits loan_detail")
def full_outer_counts(t):
    d = t("deposits").groupBy(F.col("BRANCH_NAME").alias("name")).agg(F.count_distinct("ACCOUNT_NUMBER").alias("deposits"))
    loans = t("loan_detail").groupBy(F.col("BRANCH_NAME").alias("name")).agg(F.count_distinct("ACCOUNT").alias("loans"))
    return d.join(loans, "name", "full_outer").fillna(0)


@query("jn_08_semi_join", "select count(*) as rows from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_join(t):
    wanted = t.given("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.given("orders").join(wanted, "o_custkey", "left_semi").agg(F.count("*").alias("rows"))


@query("jn_09_scalar_lookup", """select u.original_id, u.BRANCH_CODE, coalesce((select min(BRANCH_NAME) from irregular l where l.BRANCH_CODE = u.BRANCH_CODE),
    u.BRANCH_CODE) as name from users u""", "users irregular")
def scalar_lookup(t):
    return joining.first_match(t("users").select("original_id", "BRANCH_CODE"), t("irregular"), "BRANCH_CODE", "BRANCH_NAME", "name")


_DAILY = "(select {d} as day, sum(try_cast({c} as double)) as v from {t} group by 1)"


@query("jn_10_merge_series", f"""select cast(coalesce(a.day, b.day) as varchar) as day, {o.r2('coalesce(a.v, 0)')} as loans, {o.r2('coalesce(b.v, 0)')} as deposits
    from {_DAILY.format(d=DAY, c='DR_BALANCE', t='loan_detail')} a full join {_DAILY.format(d=DAY, c='CURRENT_BALANCE', t='deposit_series')} b on a.day = b.day""",
       "loan_detail deposit_series")
def merge_series(t):
    def daily(name, column, out):
        return t(name).groupBy(cleanse.date("PROC_DATE").alias("day")).agg(F.sum(numbers.as_printed(column)).alias(out))

    return joining.merge_series(daily("loan_detail", "DR_BALANCE", "loans"), daily("deposit_series", "CURRENT_BALANCE", "deposits"), "day")


@query("jn_11_lookup_by_day", f"""select cast(a.day as varchar) as day, {o.r2('a.v')} as npa, {o.r2('coalesce(b.v, 0)')} as loans from
    (select {DAY} as day, sum({o.comma_free('OUTSTANDING')}) as v from npa group by 1) a left join
    (select {DAY} as day, sum({o.comma_free('TOTAL_AMOUNT')}) as v from loan_totals group by 1) b on a.day = b.day""", "npa loan_totals")
def lookup_by_day(t):
    a = t("npa").groupBy(cleanse.date("PROC_DATE").alias("day")).agg(numbers.sum_comma_free("OUTSTANDING").alias("npa"))
    b = t("loan_totals").groupBy(cleanse.date("PROC_DATE").alias("day")).agg(numbers.sum_comma_free("TOTAL_AMOUNT").alias("loans"))
    return a.join(b, "day", "left").fillna(0.0)


@query("jn_12_join_by_label", f"""select a.name, {o.r2('case when a.v > 0 then coalesce(b.v, 0) / a.v * 100 else 0 end')} as ratio from
    (select BRANCH_NAME as name, sum({o.comma_free('TOTAL_AMOUNT')}) as v from loan_totals group by 1) a left join
    (select BRANCH_NAME as name, sum({o.comma_free('OUTSTANDING')}) as v from npa group by 1) b on a.name = b.name""", "loan_totals npa")
def join_by_label(t):
    a = t("loan_totals").groupBy(F.col("BRANCH_NAME").alias("name")).agg(numbers.sum_comma_free("TOTAL_AMOUNT").alias("lent"))
    b = t("npa").groupBy(F.col("BRANCH_NAME").alias("name")).agg(numbers.sum_comma_free("OUTSTANDING").alias("bad"))
    return a.join(b, "name", "left").select("name", numbers.ratio(F.coalesce("bad", F.lit(0.0)), F.col("lent")).alias("ratio"))


# ---------------------------------------------------------------- aggregates

@query("agg_01_comma_free_sum", f"select BRANCH_CODE, {o.r2('sum(' + o.comma_free('CURRENT_BALANCE') + ')')} as amount from deposits group by 1", "deposits")
def comma_free_sum(t):
    return t("deposits").groupBy("BRANCH_CODE").agg(numbers.sum_comma_free("CURRENT_BALANCE").alias("amount"))


@query("agg_02_as_printed_sum", f"select BRANCH_CODE, {o.r2('sum(' + o.as_printed('CURRENT_BALANCE') + ')')} as amount from deposits group by 1", "deposits")
def as_printed_sum(t):
    return t("deposits").groupBy("BRANCH_CODE").agg(numbers.sum_as_printed("CURRENT_BALANCE").alias("amount"))


@query("agg_03_conditional", f"""select ACCOUNT_CATEGORY, count(*) filter (where ACCOUNT_STATUS = 'OPEN') as open_accounts,
    cast(sum(case when CURRENT_BALANCE > 0 then CURRENT_BALANCE else 0 end) as double) as credit from {ACCOUNTS} a group by 1""", ACCOUNT_SOURCES)
def conditional(t):
    credit = F.when(F.col("CURRENT_BALANCE") > 0, F.col("CURRENT_BALANCE")).otherwise(0)
    return accounts_fact(t).groupBy("ACCOUNT_CATEGORY").agg(
        F.count_if(F.col("ACCOUNT_STATUS") == "OPEN").alias("open_accounts"), F.sum(credit).alias("credit"))


@query("agg_04_counts", f"select count(*) as rows, count(ACCOUNT_TYPE) as typed, count(CURRENT_BALANCE) as with_balance from {ACCOUNTS} a", ACCOUNT_SOURCES)
def counts(t):
    return accounts_fact(t).agg(F.count("*").alias("rows"), F.count("ACCOUNT_TYPE").alias("typed"), F.count("CURRENT_BALANCE").alias("with_balance"))


@query("agg_05_distinct", """select l_returnflag, count(distinct l_orderkey) as orders, count(distinct l_suppkey) as suppliers from lineitem group by 1""")
def distinct(t):
    return t.given("lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("agg_06_rate_stats", f"""select BRANCH_CODE, round(cast(sum(INTEREST_RATE) as double) / count(INTEREST_RATE), 4) as avg_rate,
    cast(min(INTEREST_RATE) as double) as min_rate, cast(max(INTEREST_RATE) as double) as max_rate from {ACCOUNTS} a group by 1""", ACCOUNT_SOURCES, 4)
def rate_stats(t):
    return accounts_fact(t).groupBy("BRANCH_CODE").agg(
        F.avg(F.col("INTEREST_RATE").cast("double")).alias("avg_rate"), F.min("INTEREST_RATE").alias("min_rate"), F.max("INTEREST_RATE").alias("max_rate"))


@query("agg_07_any_text", "select GL_CLASS_CODE, max(trim(NAME)) as name, min(REPORT_ID) as report from gl_totals group by 1", "gl_totals")
def any_text(t):
    return t("gl_totals").groupBy("GL_CLASS_CODE").agg(F.max(F.trim("NAME")).alias("name"), F.min("REPORT_ID").alias("report"))


@query("agg_09_share_of_total", f"""select DESCRIPT, {o.r2('v')} as amount, {o.r2('v / nullif((select sum(' + o.comma_free('OUTSTANDING') + ') from npa), 0) * 100')} as share
    from (select DESCRIPT, sum({o.comma_free('OUTSTANDING')}) as v from npa group by 1) g""", "npa")
def share_of_total(t):
    totals = t("npa").groupBy("DESCRIPT").agg(numbers.sum_comma_free("OUTSTANDING").alias("amount"))
    return ranking.with_share(totals, "amount")


@query("agg_10_side_figures", """select count(*) as orders, (select count(*) from customer) as customers, (select count(*) from supplier where s_acctbal < 0) as overdrawn from orders""")
def side_figures(t):
    return t.given("orders").agg(F.count("*").alias("orders")).select(
        "orders", t.given("customer").agg(F.count("*")).scalar().alias("customers"),
        t.given("supplier").filter("s_acctbal < 0").agg(F.count("*")).scalar().alias("overdrawn"))


_SLABS = list(dashboards.AGEING.items())
_AGEING = " union all ".join(
    f"select '{label}' as ARREARS_SLAB, cast({i} as bigint) as SORT_ORDER, count(*) filter (where coalesce({c}, 0) <> 0) as ACCOUNT_COUNT, "
    f"cast(sum(coalesce({c}, 0)) as double) as TOTAL_ARREARS from facts where SNAPSHOT_DATE = (select max(SNAPSHOT_DATE) from facts)"
    for i, (c, label) in enumerate(_SLABS, 1))


@query("agg_11_slab_counts", f"select * from (with facts as materialized (select * from {RISK} r) select ARREARS_SLAB, ACCOUNT_COUNT, TOTAL_ARREARS from ({_AGEING}) u) v", RISK_SOURCES)
def slab_counts(t):
    return dashboards.arrears_ageing(risk_fact(t)).drop("SORT_ORDER")


_PROFILE_TEXT = "select *, cast(l_quantity as string) as QTY, case l_returnflag when 'A' then '-' when 'N' then cast(l_tax as string) else 'n/a' end as TAX, cast(l_suppkey as string) as SUPP_ID, ' ' || l_linestatus as BRANCH_STATE from {lineitem}"
_PROFILE = _PROFILE_TEXT.replace("{lineitem}", "lineitem")
_FIGURES = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax QTY TAX".split()


def _sums(c: str) -> str:
    return f"select '{c}' as column_name, 'sum' as kind, {o.r2(f'sum(try_cast(cast({c} as varchar) as double))')} as total, {o.r2(f'avg(try_cast(cast({c} as varchar) as double))')} as average from p"


@query("agg_12_column_metrics", f"""with p as ({_PROFILE}) {' union all '.join(map(_sums, _FIGURES))} union all
    select 'SUPP_ID', 'distinct', cast(count(distinct SUPP_ID) as double), 0.0 from p union all
    select 'BRANCH_STATE', 'distinct', cast(count(distinct trim(BRANCH_STATE)) as double), 0.0 from p""")
def column_metrics(t):
    return profiling.column_metrics(t.sql(_PROFILE_TEXT))


@query("agg_13_branch_metrics", f"""select BRANCH_CODE, max(BRANCH_NAME) as BRANCH_NAME, 'OUTSTANDING' as metric,
    {o.r2("sum(try_cast(replace(OUTSTANDING, ',', '') as double))")} as total from npa where BRANCH_CODE <> '' group by 1""", "npa")
def branch_metrics(t):
    return profiling.branch_metrics(t("npa"))


_ZERO = "coalesce(nullif({}, ''), '0')"
_CR, _DR = (f"sum(cast({_ZERO.format(c)} as double))" for c in ("CR_BALANCE", "DR_BALANCE"))


@query("agg_14_net_gl_balance", f"select {o.r2(_CR)} as credit, {o.r2(_DR)} as debit, {o.r2(_CR + ' - ' + _DR)} as net from gl_detail", "gl_detail")
def net_gl_balance(t):
    return t("gl_detail").agg(F.sum(numbers.blank_as_zero("CR_BALANCE")).alias("credit"), F.sum(numbers.blank_as_zero("DR_BALANCE")).alias("debit")).withColumn(
        "net", F.col("credit") - F.col("debit"))


# ---------------------------------------------------------------- windows and sorts

@query("win_02_rank_by_aggregate", """select o_orderstatus as status, o_custkey as cust, n, row_number() over (partition by o_orderstatus order by n desc, o_custkey) as RNK
    from (select o_orderstatus, o_custkey, count(*) as n from orders group by 1, 2) g qualify RNK <= 10""")
def rank_by_aggregate(t):
    rows = t.given("orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust")).agg(F.count("*").alias("n"))
    return ranking.top_per_group(rows, ["status"], F.desc("n"), ["cust"], 10)


@query("win_03_latest_row", """select BRANCH_CODE, ACCOUNT_NUMBER, CURRENT_BALANCE from deposit_series
    qualify row_number() over (partition by BRANCH_CODE, ACCOUNT_NUMBER order by LOAD_SEQ desc) = 1""", "deposit_series")
def latest_row(t):
    return ranking.latest_row(t("deposit_series"), ["BRANCH_CODE", "ACCOUNT_NUMBER"], ["LOAD_SEQ"], ["CURRENT_BALANCE"])


_BY_NATION = "(select cast(c_nationkey as bigint) as nation, round(sum(c_acctbal), 2) as total from customer group by 1)"


@query("win_04_both_ranks", f"""select nation, total, rank() over (order by total desc) as RANK_TOP,
    case when rank() over (order by total desc) <= 5 then 'TOP' else 'BOTTOM' end as RANKING_CATEGORY from {_BY_NATION} g
    qualify rank() over (order by total desc) <= 5 or rank() over (order by total) <= 5""")
def both_ranks(t):
    totals = t.given("customer").groupBy(F.col("c_nationkey").cast("int").alias("nation")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return ranking.top_and_bottom(totals, "total", 5).select("nation", "total", "RANK_TOP", "RANKING_CATEGORY")


@query("srt_01_top_k", """select o_custkey, round(sum(o_totalprice), 2) as total from orders group by 1 order by 2 desc, 1 limit 10""")
def top_k(t):
    totals = t.given("orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return ranking.top_k(totals, F.desc("total"), ["o_custkey"], 10)


@query("srt_02_bottom_k", """select user_id, count(*) filter (where event_type = 'view') + count(*) filter (where event_type = 'click') as hits from events
    group by 1 order by 2, 1 limit 10""")
def bottom_k(t):
    kind = F.col("event_type")
    hits = t.given("events").groupBy("user_id").agg((F.count_if(kind == "view") + F.count_if(kind == "click")).alias("hits"))
    return ranking.top_k(hits, F.asc("hits"), ["user_id"], 10)


@query("srt_03_top_per_group", """select l_returnflag, l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_extendedprice, row_number() over (partition by l_returnflag
    order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as RNK from lineitem qualify RNK <= 3""")
def top_per_group(t):
    best = ranking.top_per_group(t.given("lineitem"), ["l_returnflag"], F.desc("l_extendedprice"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 3)
    return best.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "RNK")


@query("srt_04_top_and_bottom", f"""select nation, case when rank() over (order by total desc) <= 3 then 'HIGH' else 'LOW' end as RANKING_CATEGORY
    from {_BY_NATION} g qualify rank() over (order by total desc) <= 3 or rank() over (order by total) <= 3""")
def top_and_bottom(t):
    totals = t.given("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return ranking.top_and_bottom(totals, "total", 3, "HIGH", "LOW").select("nation", "RANKING_CATEGORY")


@query("srt_05_custom_order", """select REGIONAL_OFFICE as office, cast(case lower(REGIONAL_OFFICE) when 'head office' then 0 when 'rail head complex' then 1 else 2 end as bigint) as place,
    count(*) as branches from network where REGIONAL_OFFICE is not null group by 1, 2""", "network")
def custom_order(t):
    rows = t("network").filter("REGIONAL_OFFICE IS NOT NULL").groupBy(F.col("REGIONAL_OFFICE").alias("office")).agg(F.count("*").alias("branches"))
    return rows.withColumn("place", branches.office_order(F.col("office"))).orderBy("place", "office")


_PAGE_KEY = "try_cast(replace(replace(coalesce(CURRENT_BALANCE, '0'), ',', ''), '₹', '') as double)"


_DEPOSIT_TEXT = "ACCOUNT_NUMBER ACCOUNT_TYPE CUSTOMER_NAME AVAILABLE_BALANCE UNCLEARED_BALANCE CURRENT_BALANCE \"LIMIT\" TERM INT_RATE STATUS JOINT_HOLD_FLAG REPORT_ID BRANCH_CODE BRANCH_NAME PROC_DATE".split()


@query("srt_06_page", f"""select *, count(*) over () as total_records from deposits
    where BRANCH_CODE = '00007' and ({' or '.join(f"{c} ilike '%4020%'" for c in _DEPOSIT_TEXT)})
    order by {_PAGE_KEY} desc nulls last, ACCOUNT_NUMBER limit 20 offset 20""", "deposits")
def one_page(t):
    return explore.page(t("deposits"), "00007", "4020", descending=True, number=2, size=20)


_DETAIL_ORDER = "try_cast(replace(replace(coalesce(DR_BALANCE, '0'), ',', ''), '₹', '') as double) nulls first, ACCOUNT"


@query("srt_06_far_page", f"select *, count(*) over () as total_records from loan_detail order by {_DETAIL_ORDER} limit 50 offset 12000", "loan_detail")
def far_page(t):
    return explore.page(t("loan_detail"), number=241, size=50)


@query("srt_06_next_page", f"select * from loan_detail order by {_DETAIL_ORDER} limit 50 offset 50", "loan_detail")
def next_page(t):
    first = explore.page_after(t("loan_detail"), None).collect()
    return explore.page_after(t("loan_detail"), first[-1].asDict() if first else None)


@query("srt_07_top_with_others", """with g as (select o_custkey as cust, round(sum(o_totalprice), 2) as v from orders group by 1),
    r as (select cast(cust as varchar) as name, v, row_number() over (order by v desc, cast(cust as varchar)) as p from g)
    select case when p <= 6 then name else 'Others' end as name, round(sum(v), 2) as v from r group by 1""")
def top_with_others(t):
    rows = t.given("orders").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return ranking.top_with_others(rows, "name", "v", 6, positive_only=True)


@query("srt_08_leaderboard", f"""select * from (select nation, total, 'TOP' as board from {_BY_NATION} g order by total desc, nation limit 5) a union all
    select * from (select nation, total, 'BOTTOM' from {_BY_NATION} g order by total, nation limit 5) b""")
def leaderboard(t):
    totals = t.given("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return ranking.both_ends(totals, "total", ["nation"], 5)


# ---------------------------------------------------------------- sets

@query("set_01_slab_rows", f"select * from (with facts as materialized (select * from {RISK} r) {_AGEING}) u", RISK_SOURCES)
def slab_rows(t):
    return dashboards.arrears_ageing(risk_fact(t))


@query("set_02_distinct_regions", "select distinct REGIONAL_OFFICE as region from network where REGIONAL_OFFICE is not null", "network")
def distinct_regions(t):
    return branches.regions(t("network"))
