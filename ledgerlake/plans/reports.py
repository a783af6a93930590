"""Dashboard queries over the staging tables.

``network`` is the branch network; ``branch`` a scope (ALL, a code or REGION:x); ``period``,
``start`` and ``end`` a period scope. Names shown on screen are cut to their display width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleanse, labels, numbers
from ..operators import explore, joining, profiling, ranking, scope

DEPOSITS, LOAN_DETAIL, NPA = "DEPOSITS_BALANCE_FILE_DEPD0586", "BAL_IN_LOAN_ACC_GLCC_WISE_DET", "LIST_OF_NPA_ACCOUNTS"
ALL = "ALL"


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _present(*names: str) -> Column:
    keep = F.lit(True)
    for n in names:
        keep = keep & (F.col(n) != "")
    return keep


# ---------------------------------------------------------------- notices and totals

def notifications(npa: DataFrame, loans: DataFrame, closed: DataFrame, branch: str = ALL, network: DataFrame | None = None) -> DataFrame:
    """(kind, branch_code, branch_name, amount, accounts): worst NPA branch, number of closures."""
    by_branch = scope.in_branch(npa, branch, network).groupBy("BRANCH_CODE").agg(numbers.sum_comma_free("OUTSTANDING").alias("amount"))
    worst = by_branch.orderBy(F.desc_nulls_last("amount"), "BRANCH_CODE").limit(1).filter("amount > 0")
    worst = joining.first_match(worst, loans, "BRANCH_CODE", "BRANCH_NAME", "branch_name")
    closures = scope.in_branch(closed, branch, network).agg(F.count("*").alias("accounts")).filter("accounts > 0")
    return worst.select(
        F.lit("High NPA Alert").alias("kind"), F.col("BRANCH_CODE").alias("branch_code"),
        labels.display_name(F.col("branch_name")).alias("branch_name"), "amount", F.lit(None).cast("bigint").alias("accounts"),
    ).unionByName(closures.select(
        F.lit("Account Closures").alias("kind"), F.lit(branch).alias("branch_code"), F.lit(None).cast("string").alias("branch_name"),
        F.lit(None).cast("double").alias("amount"), "accounts"))


def deposits_by_status(shadow: DataFrame, branch: str = ALL, network: DataFrame | None = None) -> DataFrame:
    """(status, code, accounts, amount); codes without a label are Others."""
    rows = scope.in_branch(shadow, branch, network, "BRNO")
    return rows.groupBy(F.coalesce(F.trim("STATUS"), F.lit("")).alias("code")).agg(
        F.count("*").alias("accounts"), _or_zero(numbers.sum_comma_free("CURRBAL")).alias("amount")
    ).withColumn("status", labels.deposit_status("code")).select("status", "code", "accounts", "amount")


def loans_by_scheme(shadow: DataFrame, branch: str = ALL, network: DataFrame | None = None) -> DataFrame:
    rows = scope.in_branch(shadow, branch, network, "BRNO")
    return rows.groupBy(F.coalesce("SCHEMEDESC", F.lit("Unknown Scheme")).alias("scheme_name")).agg(
        F.count("*").alias("accounts"), F.abs(_or_zero(numbers.sum_comma_free("CURRBAL"))).alias("amount")
    ).select(F.substring("scheme_name", 1, 25).alias("scheme"), "accounts", "amount").orderBy(F.desc("accounts"), "scheme")


def master_stats(deposit_shadow: DataFrame, loan_shadow: DataFrame, branch: str = ALL, network: DataFrame | None = None) -> DataFrame:
    """(section, label, accounts, amount): deposits by status, loans by scheme, and both totals."""
    deposits = deposits_by_status(deposit_shadow, branch, network)
    loans = loans_by_scheme(loan_shadow, branch, network)
    loan_total = scope.in_branch(loan_shadow, branch, network, "BRNO").agg(
        F.count("*").alias("accounts"), F.abs(_or_zero(numbers.sum_comma_free("CURRBAL"))).alias("amount"))
    parts = [
        deposits.groupBy(F.col("status").alias("label")).agg(F.sum("accounts").alias("accounts"), F.sum("amount").alias("amount"))
        .withColumn("section", F.lit("deposits")),
        loans.select(F.lit("loans").alias("section"), F.col("scheme").alias("label"), "accounts", "amount"),
        deposits.agg(F.coalesce(F.sum("accounts"), F.lit(0)).alias("accounts"), _or_zero(F.sum("amount")).alias("amount"))
        .select(F.lit("deposits total").alias("section"), F.lit("").alias("label"), "accounts", "amount"),
        loan_total.select(F.lit("loans total").alias("section"), F.lit("").alias("label"), "accounts", "amount"),
    ]
    out = parts[0].select("section", "label", "accounts", "amount")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- per branch or region

def top_deposit_branches(deposits: DataFrame, branch: str = ALL, network: DataFrame | None = None, period: str = ALL,
                         start: str | None = None, end: str | None = None, k: int = 10) -> DataFrame:
    rows = scope.scoped(deposits, DEPOSITS, branch, network, period, start, end)
    totals = rows.groupBy("BRANCH_NAME").agg(numbers.sum_as_printed("CURRENT_BALANCE").alias("deposits"))
    best = ranking.top_k(totals, F.desc_nulls_last("deposits"), ["BRANCH_NAME"], k)
    return best.select(labels.display_name(F.col("BRANCH_NAME")).alias("name"), _or_zero(F.col("deposits")).alias("deposits"))


def movements_by_branch(rows: DataFrame, date_column: str, network: DataFrame, branch: str = ALL, period: str = ALL,
                        start: str | None = None, end: str | None = None) -> DataFrame:
    """Opened or closed accounts per region (ALL) or branch, split into loans and deposits."""
    named = scope.group_label(
        scope.scoped(rows, None, branch, network, period, start, end, date_column), branch, network)
    loan = F.col("PRODUCT").startswith("6")
    return named.groupBy("group_name").agg(
        F.count("*").alias("value"), F.count_if(loan).alias("loan_accounts"), F.count_if(~loan).alias("deposit_accounts")
    ).select(labels.display_name(F.col("group_name")).alias("name"), "value", "loan_accounts", "deposit_accounts").orderBy(
        F.desc("value"), "name")


def accounts_by_branch(deposits: DataFrame, loans: DataFrame, network: DataFrame, branch: str = ALL, period: str = ALL,
                       start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct deposit and loan accounts per region or branch; nameless groups of the two sides stay apart."""
    def distinct(df: DataFrame, table: str, account: str, out: str) -> DataFrame:
        named = scope.group_label(scope.scoped(df, table, branch, network, period, start, end), branch, network)
        return named.groupBy("group_name").agg(F.count_distinct(account).alias(out))

    d = distinct(deposits, DEPOSITS, "ACCOUNT_NUMBER", "deposit_accounts")
    both = d.join(distinct(loans, LOAN_DETAIL, "ACCOUNT", "loan_accounts"), "group_name", "full_outer").fillna(0)
    return both.select(
        labels.display_name(F.col("group_name")).alias("name"), (F.col("deposit_accounts") + F.col("loan_accounts")).alias("value"),
        "loan_accounts", "deposit_accounts").orderBy(F.desc("value"), "name")


def _shadow_by_branch(shadow: DataFrame, network: DataFrame, branch: str) -> DataFrame:
    rows = scope.in_branch(shadow, branch, network, "BRNO")
    if branch and branch != ALL and "BRANCH_NAME" not in rows.columns:
        # Shadow rows carry no branch name; a single branch is shown under its name in the network.
        names = network.select(F.col("BRANCH_CODE").alias("BRNO"), "BRANCH_NAME")
        rows = rows.join(names, "BRNO", "left")
    return scope.group_label(rows, branch, network, "BRNO").groupBy("group_name").agg(
        _or_zero(numbers.sum_comma_free("CURRBAL")).alias("value"), F.count("*").alias("account_count"))


def shadow_deposits_by_branch(shadow: DataFrame, network: DataFrame, branch: str = ALL) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("group_name"), F.lit("")), F.lit("Unknown"))
    return _shadow_by_branch(shadow, network, branch).select(name.alias("name"), "value", "account_count").orderBy(
        F.desc("value"), "name")


def shadow_loans_by_branch(shadow: DataFrame, network: DataFrame, branch: str = ALL) -> DataFrame:
    return _shadow_by_branch(shadow, network, branch).select(
        labels.display_name(F.col("group_name")).alias("name"), F.col("value").alias("loans")).orderBy(F.desc("loans"), "name")


def npa_by_branch(npa: DataFrame, network: DataFrame, branch: str = ALL, period: str = ALL, start: str | None = None,
                  end: str | None = None) -> DataFrame:
    rows = scope.scoped(npa, NPA, branch, network, period, start, end).filter(_present("BRANCH_CODE"))
    return scope.group_label(rows, branch, network).groupBy("group_name").agg(
        _or_zero(numbers.sum_comma_free("OUTSTANDING")).alias("npa")
    ).select(labels.display_name(F.col("group_name")).alias("name"), "npa").orderBy(F.desc("npa"), "name")


# ---------------------------------------------------------------- headline figures

def latest_deposits(deposits: DataFrame, order: list[str]) -> DataFrame:
    """Newest row per branch and account; the load order must be declared."""
    return ranking.latest_row(deposits, ["BRANCH_CODE", "ACCOUNT_NUMBER"], order, ["CURRENT_BALANCE"])


def kpi_summary(deposits: DataFrame, loans: DataFrame, npa: DataFrame, order: list[str], branch: str = ALL,
                network: DataFrame | None = None, period: str = ALL, start: str | None = None, end: str | None = None) -> DataFrame:
    """Deposits without repeated account rows, loans, NPA, and the number of reporting branches."""
    dated = scope.in_period(deposits, period, start, end, DEPOSITS)
    mine = latest_deposits(scope.in_branch(dated, branch, network), order)
    reporting = dated.agg(F.count_distinct("BRANCH_CODE")).scalar() if branch == ALL else F.lit(1)
    loan_total = scope.scoped(loans, LOAN_DETAIL, branch, network, period, start, end).agg(numbers.sum_comma_free("DR_BALANCE")).scalar()
    npa_total = scope.scoped(npa, NPA, branch, network, period, start, end).agg(numbers.sum_comma_free("OUTSTANDING")).scalar()
    return mine.agg(_or_zero(numbers.sum_comma_free("CURRENT_BALANCE")).alias("total_deposits")).select(
        "total_deposits", _or_zero(loan_total).alias("total_loans"), _or_zero(npa_total).alias("total_npa"),
        reporting.cast("bigint").alias("branches_reporting"))


def kpi_counts(opened: DataFrame, closed: DataFrame, gl: DataFrame, loans: DataFrame, deposits: DataFrame, members: DataFrame,
               branch: str = ALL, network: DataFrame | None = None) -> DataFrame:
    def rows(df: DataFrame) -> Column:
        return scope.in_branch(df, branch, network).agg(F.count("*")).scalar()

    return scope.in_branch(gl, branch, network).agg(
        _or_zero(F.sum(numbers.blank_as_zero("CR_BALANCE"))).alias("total_cr_balance"),
        _or_zero(F.sum(numbers.blank_as_zero("DR_BALANCE"))).alias("total_dr_balance"),
    ).select(
        rows(opened).alias("total_opened"), rows(closed).alias("total_closed"),
        (F.col("total_cr_balance") - F.col("total_dr_balance")).alias("total_gl_balance"), "total_cr_balance", "total_dr_balance",
        rows(loans).alias("total_loans"), rows(deposits).alias("total_deposits"), rows(members).alias("total_members"))


def account_metrics(deposits: DataFrame, loans: DataFrame, opened: DataFrame, closed: DataFrame, branch: str = ALL,
                    network: DataFrame | None = None, period: str = ALL, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct accounts on each report's newest day; opened and closed in the period."""
    def newest(df: DataFrame, account: str) -> Column:
        rows = scope.in_branch(df.filter(scope.day_of(df, "PROC_DATE") == scope.newest_day(df)), branch, network)
        return rows.agg(F.count_distinct(account)).scalar()

    def moved(df: DataFrame, column: str) -> DataFrame:
        return scope.scoped(df, None, branch, network, period, start, end, column).agg(F.count("*").alias("n"))

    return moved(opened, "OPENED_DATE").select(
        F.col("n").alias("opened"), moved(closed, "CLOSED_DATE").scalar().alias("closed"),
        (newest(deposits, "ACCOUNT_NUMBER") + newest(loans, "ACCOUNT")).alias("total"))


def loan_npa_totals(loans: DataFrame, npa: DataFrame, branch: str = ALL, network: DataFrame | None = None) -> DataFrame:
    bad = scope.in_branch(npa, branch, network).agg(numbers.sum_comma_free("OUTSTANDING")).scalar()
    return scope.in_branch(loans, branch, network).agg(F.abs(_or_zero(numbers.sum_as_printed("DR_BALANCE"))).alias("total_loans")).select(
        "total_loans", F.abs(_or_zero(bad)).alias("total_npa"))


# ---------------------------------------------------------------- ledgers and products

def gl_volume(gl: DataFrame, branch: str = ALL, network: DataFrame | None = None, k: int = 6) -> DataFrame:
    rows = scope.in_branch(gl.filter(_present("LEDGER_NAME")), branch, network)
    totals = rows.groupBy("LEDGER_NAME", "BRANCH_NAME").agg(
        F.sum(numbers.blank_as_zero("CR_BALANCE") + numbers.blank_as_zero("DR_BALANCE")).alias("value"))
    best = ranking.top_k(totals, F.desc_nulls_last("value"), ["LEDGER_NAME", "BRANCH_NAME"], k)
    name = F.when(F.col("BRANCH_NAME") != "", F.concat("LEDGER_NAME", F.lit(" ("), "BRANCH_NAME", F.lit(")"))).otherwise(
        F.col("LEDGER_NAME"))
    return best.select(name.alias("name"), _or_zero(F.col("value")).alias("value"))


def deposits_by_type(deposits: DataFrame, branch: str = ALL, network: DataFrame | None = None, k: int = 8) -> DataFrame:
    rows = scope.in_branch(deposits.filter(_present("ACCOUNT_TYPE")), branch, network)
    counts = rows.groupBy(F.col("ACCOUNT_TYPE").alias("name")).agg(F.count("*").alias("value"))
    return ranking.top_k(counts, F.desc("value"), ["name"], k)


def product_transfers(flows: DataFrame, branch: str = ALL, network: DataFrame | None = None, k: int = 6) -> DataFrame:
    rows = scope.in_branch(flows.filter(_present("PROD_DESC")), branch, network)
    totals = rows.groupBy("PROD_DESC").agg(
        F.sum(numbers.numeric_else_zero("TRANSFER_CREDIT")).alias("credit"), F.sum(numbers.numeric_else_zero("TRANSFER_DEBIT")).alias("debit"))
    best = ranking.top_k(totals, F.desc("credit"), ["PROD_DESC"], k)
    return best.select(labels.display_name(F.col("PROD_DESC"), 20).alias("name"), "credit", "debit")


def glcc_largest(totals: DataFrame, branch: str = ALL, network: DataFrame | None = None, k: int = 8) -> DataFrame:
    """Largest rows (not groups) by amount without its sign."""
    rows = scope.in_branch(totals.filter(_present("NAME", "TOTAL_AMOUNT")), branch, network)
    amount = F.translate("TOTAL_AMOUNT", ",-", "").try_cast("double")
    accounts = F.when(F.col("ACT_TOTAL").rlike("^[0-9]+$"), F.col("ACT_TOTAL").try_cast("bigint"))
    picked = rows.select(
        labels.display_name(F.col("NAME"), 25).alias("name"), F.coalesce(accounts, F.lit(0)).alias("accounts"), amount.alias("amount"),
        *[F.col(c).alias(f"_{c}") for c in ("NAME", "GL_CLASS_CODE", "BRANCH_CODE", "PROC_DATE")])
    best = ranking.top_k(picked, F.desc_nulls_last("amount"), ["_NAME", "_GL_CLASS_CODE", "_BRANCH_CODE", "_PROC_DATE", "accounts"], k)
    return best.select("name", "accounts", _or_zero(F.col("amount")).alias("amount"))


def daybook_by_type(daybook: DataFrame, branch: str = ALL, network: DataFrame | None = None, k: int = 6) -> DataFrame:
    rows = scope.in_branch(daybook.filter(_present("TXN_TYPE")), branch, network)
    totals = rows.groupBy("TXN_TYPE").agg(F.count("*").alias("count"), F.sum(numbers.numeric_else_zero("DEBIT")).alias("amount"))
    best = ranking.top_k(totals, F.desc("count"), ["TXN_TYPE"], k)
    return best.select(labels.display_name(F.col("TXN_TYPE"), 22).alias("name"), "count", "amount")


# ---------------------------------------------------------------- lists

def _dash(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("-"))


def _first_rows(df: DataFrame, k: int) -> DataFrame:
    """The reference takes any k rows; here the k smallest by all shown columns."""
    return df.orderBy(*[F.asc_nulls_first(c) for c in df.columns]).limit(k)


def exceptions_list(rows: DataFrame, k: int = 10) -> DataFrame:
    return _first_rows(rows.select(
        F.col("ACCOUNT_NO").alias("account_no"), F.col("AMOUNT").alias("amount"), _dash("CUSTOMER_NAME").alias("customer_name"),
        _dash("ERROR_DESC").alias("error_desc"), F.col("OUTSTANDING").alias("outstanding")), k)


def drawing_power_list(rows: DataFrame, k: int = 10) -> DataFrame:
    return _first_rows(rows.select(
        F.col("CUSTOMER_NAME").alias("customer_name"), F.col("ACCOUNT_NO").alias("account_no"), F.col("OUTSTANDING").alias("outstanding"),
        F.col("DRAWING_POWER").alias("drawing_power"), F.col("IRREGULARITY").alias("irregularity")), k)


def alterations_list(rows: DataFrame, k: int = 10) -> DataFrame:
    """Newest first by the real date."""
    shown = rows.select(
        F.col("ACCOUNT_NO").alias("account_no"), F.col("CUSTOMER_NAME").alias("customer_name"), F.col("INT_RATE_OLD").alias("old_rate"),
        F.col("INT_RATE_NEW").alias("new_rate"), cleanse.iso_day("PROC_DATE").alias("date"),
        *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A")).alias(n)
          for c, n in (("BRANCH_NAME", "branch_name"), ("ACCT_TYPE_OLD", "old_type"), ("ACCT_TYPE_NEW", "new_type"))])
    return shown.orderBy(F.desc_nulls_last("date"), *[F.asc_nulls_first(c) for c in shown.columns]).limit(k)


def deposit_balance_list(rows: DataFrame, k: int = 10) -> DataFrame:
    return _first_rows(rows.filter(_present("CURRENT_BALANCE")).select(
        F.col("ACCOUNT_NUMBER").alias("account_no"), _dash("CUSTOMER_NAME").alias("customer_name"), _dash("ACCOUNT_TYPE").alias("account_type"),
        F.col("CURRENT_BALANCE").alias("current_balance"), F.col("INT_RATE").alias("int_rate"), _dash("STATUS").alias("status"),
        _dash("JOINT_HOLD_FLAG").alias("joint")), k)


def rate_exceptions_list(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("ACCOUNT_NUMBER").alias("account_no"), F.col("CUSTOMER_NAME").alias("customer_name"),
        F.col("SANCTION_AMOUNT").alias("sanction_amount"), F.col("PRODUCT_INT_RATE").alias("product_rate"),
        F.col("EFFECTIVE_INT_RATE").alias("effective_rate"))


def least_active_users(rows: DataFrame, branch: str = ALL, network: DataFrame | None = None, k: int = 10) -> DataFrame:
    mine = scope.in_branch(rows.filter(_present("original_id")), branch, network)

    def figure(name: str) -> Column:
        return _or_zero(F.nullif(F.col(name), F.lit("")).try_cast("double"))

    shown = mine.select(
        F.trim("original_id").alias("id"), figure("NO_OF_TXNS_DEBIT").alias("debit"), figure("NO_OF_TXNS_CREDIT").alias("credit"),
        figure("MEMO_HITS").alias("hits"))
    return ranking.top_k(shown, (F.col("debit") + F.col("credit")).asc(), ["id", "debit", "credit", "hits"], k)


# ---------------------------------------------------------------- loans and NPA

def loan_types(loans: DataFrame, branch: str = ALL, network: DataFrame | None = None, period: str = ALL, start: str | None = None,
               end: str | None = None, k: int = 10) -> DataFrame:
    rows = scope.scoped(loans, LOAN_DETAIL, branch, network, period, start, end)
    totals = rows.groupBy("PRODUCT_NAME").agg(numbers.sum_as_printed("DR_BALANCE").alias("value"))
    best = ranking.top_k(totals, F.desc_nulls_last("value"), ["PRODUCT_NAME"], k)
    raw = F.coalesce(F.nullif(F.col("PRODUCT_NAME"), F.lit("")), F.lit("Unknown"))
    return best.select(labels.display_name(F.col("PRODUCT_NAME"), 30).alias("name"), raw.alias("raw_name"), _or_zero(F.col("value")).alias("value"))


def loan_type_branches(loans: DataFrame, product: str, branch: str = ALL, network: DataFrame | None = None, period: str = ALL,
                       start: str | None = None, end: str | None = None) -> DataFrame:
    rows = scope.scoped(loans, LOAN_DETAIL, branch, network, period, start, end).filter(F.col("PRODUCT_NAME") == product)
    totals = rows.groupBy("BRANCH_NAME").agg(_or_zero(numbers.sum_as_printed("DR_BALANCE")).alias("value"))
    return totals.select(labels.display_name(F.col("BRANCH_NAME")).alias("name"), "value").orderBy(F.desc("value"), "name")


def trend(loans: DataFrame, deposits: DataFrame, branch: str = ALL, network: DataFrame | None = None, period: str = ALL,
          start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily loans and deposits; a period in days gives one row per day up to the last date, 0 where none."""
    def daily(df: DataFrame, table: str, column: str, out: str) -> DataFrame:
        rows = scope.scoped(df, table, branch, network, period, start, end)
        return rows.groupBy(scope.day_of(df, "PROC_DATE").alias("day")).agg(_or_zero(numbers.sum_as_printed(column)).alias(out))

    series = joining.merge_series(
        daily(loans, LOAN_DETAIL, "DR_BALANCE", "loans"), daily(deposits, DEPOSITS, "CURRENT_BALANCE", "deposits"), "day")
    days = scope.PERIOD_DAYS.get(period)
    if days:
        last = series.agg(F.max("day").alias("last"))
        calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
        series = calendar.join(series, "day", "left").fillna(0.0)
    return series.select(F.date_format("day", "yyyy-MM-dd").alias("name"), "loans", "deposits").orderBy("name")


def npa_by_facility(npa: DataFrame, branch: str = ALL, network: DataFrame | None = None, period: str = ALL, start: str | None = None,
                    end: str | None = None) -> DataFrame:
    rows = scope.scoped(npa, NPA, branch, network, period, start, end)
    totals = rows.groupBy("DESCRIPT").agg(_or_zero(numbers.sum_comma_free("OUTSTANDING")).alias("amount"))
    shared = ranking.with_share(totals, "amount", "pct")
    return shared.select(
        F.coalesce(F.nullif(F.col("DESCRIPT"), F.lit("")), F.lit("Unknown")).alias("category"), F.round("amount", 2).alias("amount"), "pct")


def ageing_exceptions(rows: DataFrame, branch: str = ALL, network: DataFrame | None = None, period: str = ALL,
                      start: str | None = None, end: str | None = None) -> DataFrame:
    counted = scope.scoped(rows, None, branch, network, period, start, end).agg(F.count("*").alias("count")).filter("count > 0")
    return counted.select(F.lit("BGL Aging Exceptions").alias("title"), "count")


def loans_dashboard(totals: DataFrame, npa: DataFrame, irregular: DataFrame, loans: DataFrame, branch: str = ALL,
                    network: DataFrame | None = None, period: str = ALL, start: str | None = None, end: str | None = None) -> DataFrame:
    """(section, name, value): overview, products, branches, NPA and irregular amounts by branch."""
    glcc = scope.scoped(totals, None, branch, network, period, start, end)
    bad = scope.scoped(npa, NPA, branch, network, period, start, end)
    odd = scope.scoped(irregular, None, branch, network, period, start, end)

    def overview(df: DataFrame, column: str, name: str) -> DataFrame:
        plain = F.replace(F.col(column), F.lit(","), F.lit("")).try_cast("double")
        return df.agg(_or_zero(F.sum(plain)).alias("value")).select(F.lit("overview").alias("section"), F.lit(name).alias("name"), "value")

    def section(name: str, grouped: DataFrame, label: Column) -> DataFrame:
        return grouped.filter("value <> 0").select(F.lit(name).alias("section"), label.alias("name"), "value")

    def total(df: DataFrame, column: str, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(numbers.sum_comma_free(column).alias("value"))

    npa_named = joining.first_match(total(bad, "OUTSTANDING", "BRANCH_CODE"), loans, "BRANCH_CODE", "BRANCH_NAME", "label")
    unknown = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("Unknown"))
    odd_named = total(odd, "IRREGULARITY", "BRANCH_NAME", "BRANCH_CODE").withColumn("label", F.coalesce("BRANCH_NAME", "BRANCH_CODE"))
    parts = [
        overview(glcc, "TOTAL_AMOUNT", "total_loans"), overview(bad, "OUTSTANDING", "total_npa"),
        overview(odd, "IRREGULARITY", "total_irregular"),
        section("products", total(glcc, "TOTAL_AMOUNT", "NAME").filter(_present("NAME")), F.col("NAME")),
        section("branches", total(glcc, "TOTAL_AMOUNT", "BRANCH_NAME").filter(_present("BRANCH_NAME")), F.col("BRANCH_NAME")),
        section("branch_npa", npa_named, unknown), section("branch_irregular", odd_named, unknown),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def deposits_dashboard(deposits: DataFrame, branch: str = ALL, network: DataFrame | None = None) -> DataFrame:
    """(section, name, value): totals with CASA and term parts, by product, by branch. No period applies."""
    rows = scope.in_branch(deposits, branch, network).withColumn("_v", numbers.comma_free("AVAILABLE_BALANCE"))
    kinds = rows.agg(
        _or_zero(F.sum("_v")).alias("total_deposits"),
        _or_zero(F.sum(F.when(labels.is_casa("ACCOUNT_TYPE"), F.col("_v")).otherwise(0.0))).alias("casa_deposits"),
        _or_zero(F.sum(F.when(labels.is_term("ACCOUNT_TYPE"), F.col("_v")).otherwise(0.0))).alias("term_deposits"))
    overview = kinds.unpivot([], kinds.columns, "name", "value").select(F.lit("overview").alias("section"), "name", "value")
    products = rows.groupBy("ACCOUNT_TYPE").agg(F.sum("_v").alias("value")).filter("value <> 0").select(
        F.lit("products").alias("section"), F.coalesce("ACCOUNT_TYPE", F.lit("Other")).alias("name"), "value")
    label = F.coalesce(F.nullif(F.coalesce("BRANCH_NAME", "BRANCH_CODE"), F.lit("")), F.lit("Unknown"))
    places = rows.groupBy("BRANCH_NAME", "BRANCH_CODE").agg(F.sum("_v").alias("value")).filter("value <> 0").select(
        F.lit("branches").alias("section"), label.alias("name"), "value")
    return overview.unionByName(products).unionByName(places)


def npa_trend(npa: DataFrame, totals: DataFrame, branch: str = ALL, network: DataFrame | None = None, period: str = ALL,
              start: str | None = None, end: str | None = None) -> DataFrame:
    """NPA per date as a share of loans (0 where no loans are known) and in lakhs."""
    def daily(df: DataFrame, table: str | None, column: str, out: str) -> DataFrame:
        rows = scope.scoped(df, table, branch, network, period, start, end)
        return rows.groupBy(scope.day_of(df, "PROC_DATE").alias("day")).agg(_or_zero(numbers.sum_comma_free(column)).alias(out))

    both = daily(npa, NPA, "OUTSTANDING", "bad").join(daily(totals, None, "TOTAL_AMOUNT", "lent"), "day", "left")
    lent = _or_zero(F.col("lent"))
    return both.select(
        F.date_format("day", "yyyy-MM-dd").alias("name"), F.round(numbers.ratio(F.col("bad"), lent), 2).alias("value"),
        numbers.lakhs(F.col("bad")).alias("npa_lakhs")).orderBy("name")


# ---------------------------------------------------------------- on-screen roll-ups

def npa_ratio(branch_loans: DataFrame, branch_npa: DataFrame) -> DataFrame:
    """NPA as percent of loans per branch label (name, value frames), and overall."""
    bad = branch_npa.groupBy("name").agg(F.sum("value").alias("bad"))
    by_branch = branch_loans.join(bad, "name", "left").select(
        "name", F.round(numbers.ratio(_or_zero(F.col("bad")), F.col("value")), 2).alias("value"))
    whole = branch_loans.agg(F.sum("value").alias("lent")).select(
        F.lit("ALL").alias("name"),
        F.round(numbers.ratio(_or_zero(branch_npa.agg(F.sum("value")).scalar()), _or_zero(F.col("lent"))), 2).alias("value"))
    return by_branch.unionByName(whole)


def casa_ratio(deposits: DataFrame, branch: str = ALL, network: DataFrame | None = None) -> DataFrame:
    rows = scope.in_branch(deposits, branch, network).withColumn("_v", numbers.comma_free("AVAILABLE_BALANCE"))
    sums = rows.agg(_or_zero(F.sum("_v")).alias("all"), _or_zero(F.sum(F.when(labels.is_casa("ACCOUNT_TYPE"), F.col("_v")))).alias("casa"))
    return sums.select(F.round(numbers.ratio(F.col("casa"), F.col("all")), 1).alias("casa_ratio"))


def shares(rows: DataFrame, name: str, amount: str, text: str = "") -> DataFrame:
    """Share of each row in the rows found by name, by magnitude."""
    found = scope.search(rows, text.strip(), [name]).select(F.col(name).alias("name"), numbers.screen_number(amount).alias("value"))
    return ranking.with_share(found, "value", "share").orderBy(F.desc("value"), "name")


def report_profile(df: DataFrame, branch: str = ALL) -> DataFrame:
    """(part, name, total, average): rows, column metrics and the values of the first plain column."""
    rows = df.filter(F.col("BRANCH_CODE") == branch) if branch != ALL and "BRANCH_CODE" in df.columns else df
    out = rows.agg(F.count("*").cast("double").alias("total")).select(
        F.lit("rows").alias("part"), F.lit("").alias("name"), "total", F.lit(0.0).alias("average"))
    metrics = profiling.column_metrics(rows)
    out = out.unionByName(metrics.select(F.col("kind").alias("part"), F.col("column_name").alias("name"), "total", "average"))
    column = profiling.first_category(rows)
    if column:
        values = profiling.value_frequencies(rows, column)
        out = out.unionByName(values.select(
            F.lit("value").alias("part"), F.col("value").alias("name"), F.col("rows").cast("double").alias("total"),
            F.lit(0.0).alias("average")))
    return out


def explorer_page(df: DataFrame, branch: str = ALL, text: str = "", sort_by: str = "", descending: bool = False, number: int = 1,
                  size: int = 50) -> DataFrame:
    return explore.page(df, branch, text, sort_by, descending, number, size)


def auto_metrics(df: DataFrame, table: str | None = None, branch: str = ALL, network: DataFrame | None = None, period: str = ALL,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    return profiling.branch_metrics(scope.scoped(df, table, branch, network, period, start, end))


def shadow_inspection(deposit_shadow: DataFrame, loan_shadow: DataFrame) -> DataFrame:
    """(section, label, accounts, amount): row counts, statuses and schemes of the shadow tables."""
    def block(df: DataFrame, name: str) -> DataFrame:
        counted = df.agg(F.count("*").alias("accounts"), _or_zero(numbers.sum_comma_free("CURRBAL")).alias("amount"))
        head = counted.select(F.lit(f"{name} rows").alias("section"), F.lit("").alias("label"), "accounts", "amount")
        statuses = df.groupBy(F.col("STATUS").alias("label")).agg(
            F.count("*").alias("accounts"), _or_zero(numbers.sum_comma_free("CURRBAL")).alias("amount"))
        return head.unionByName(statuses.select(F.lit(f"{name} status").alias("section"), "label", "accounts", "amount"))

    schemes = loan_shadow.groupBy(F.coalesce("SCHEMEDESC", F.lit("Unknown Scheme")).alias("label")).agg(
        F.count("*").alias("accounts"), _or_zero(numbers.sum_comma_free("CURRBAL")).alias("amount"))
    return block(deposit_shadow, "deposits").unionByName(block(loan_shadow, "loans")).unionByName(
        schemes.select(F.lit("loans scheme").alias("section"), "label", "accounts", "amount"))
