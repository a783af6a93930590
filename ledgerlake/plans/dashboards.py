"""Executive dashboards over the warehouse facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import ranking, scope


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _on_day(df: DataFrame, day: Column, branch: str | None = None) -> DataFrame:
    rows = df.filter(F.col("SNAPSHOT_DATE") == day)
    return rows if branch is None else rows.filter(F.col("BRANCH_CODE") == branch)


def executive_kpis(accounts: DataFrame, risk: DataFrame, audit: DataFrame, day: str | None = None,
                   branch: str | None = None) -> DataFrame:
    """One row, also without data: counts by category are then NULL, like any sum over nothing.

    The three facts are reduced to one row each; the side figures enter as scalar subqueries.
    """
    on = scope.report_day(accounts, day)
    kind, status = F.col("ACCOUNT_CATEGORY"), F.col("ACCOUNT_STATUS")
    npa = _on_day(risk, on, branch).filter("IS_CONFIRMED_NPA")
    critical = _on_day(audit, on, branch).filter(F.col("SEVERITY").isin("HIGH", "CRITICAL"))

    def rows_where(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    def amount_where(category: str, value: Column) -> Column:
        return F.sum(F.when(kind == category, value).otherwise(0))

    return _on_day(accounts, on, branch).agg(
        rows_where(kind == "DEPOSIT").alias("TOTAL_DEPOSIT_ACCOUNTS"), rows_where(kind == "LOAN").alias("TOTAL_LOAN_ACCOUNTS"),
        rows_where(kind == "CC_OD").alias("TOTAL_CCOD_ACCOUNTS"), F.count("ACCOUNT_NO").alias("TOTAL_ACCOUNTS"),
        amount_where("DEPOSIT", _or_zero("CURRENT_BALANCE")).alias("TOTAL_DEPOSITS"),
        amount_where("LOAN", _or_zero("OUTSTANDING")).alias("TOTAL_ADVANCES"),
        amount_where("CC_OD", F.abs(_or_zero("CURRENT_BALANCE"))).alias("TOTAL_CCOD_OUTSTANDING"),
        rows_where(status == "OPEN").alias("OPEN_ACCOUNTS"), rows_where(status == "CLOSED").alias("CLOSED_ACCOUNTS"),
    ).select(
        on.alias("REPORT_DATE"), "*",
        npa.agg(F.count("ACCOUNT_NO")).scalar().alias("TOTAL_NPA_ACCOUNTS"),
        npa.agg(F.coalesce(F.sum("BALANCE_OUTSTANDING"), F.lit(0))).scalar().alias("TOTAL_NPA_OUTSTANDING"),
        critical.agg(F.count("*")).scalar().alias("CRITICAL_EXCEPTIONS"),
    )


def business_mix(accounts: DataFrame, day: str | None = None) -> DataFrame:
    return _on_day(accounts, scope.report_day(accounts, day)).groupBy("ACCOUNT_CATEGORY").agg(
        F.count("ACCOUNT_NO").alias("ACCOUNT_COUNT"), F.sum(labels.category_volume()).alias("TOTAL_VOLUME"),
        F.avg("INTEREST_RATE").alias("AVG_INTEREST_RATE"), F.min("INTEREST_RATE").alias("MIN_INTEREST_RATE"),
        F.max("INTEREST_RATE").alias("MAX_INTEREST_RATE"),
    ).orderBy(F.desc("TOTAL_VOLUME"), "ACCOUNT_CATEGORY")


def product_portfolio(accounts: DataFrame, day: str | None = None, n: int = 10, branch: str | None = None) -> DataFrame:
    """Largest products per category; products without a type are shown as UNKNOWN."""
    rows = _on_day(accounts, scope.report_day(accounts, day), branch).groupBy("ACCOUNT_CATEGORY", "ACCOUNT_TYPE").agg(
        F.count("ACCOUNT_NO").alias("ACCOUNT_COUNT"), F.sum(labels.book_balance()).alias("TOTAL_BALANCE"),
        F.avg("INTEREST_RATE").alias("AVG_RATE"))
    rows = rows.withColumn("PRODUCT_TYPE", F.coalesce("ACCOUNT_TYPE", F.lit("UNKNOWN"))).drop("ACCOUNT_TYPE")
    best = ranking.top_per_group(rows, ["ACCOUNT_CATEGORY"], F.desc("TOTAL_BALANCE"), ["PRODUCT_TYPE", "ACCOUNT_COUNT"], n)
    return best.select(
        "ACCOUNT_CATEGORY", "PRODUCT_TYPE", "ACCOUNT_COUNT", "TOTAL_BALANCE", "AVG_RATE", "RNK").orderBy("ACCOUNT_CATEGORY", "RNK")


# Display order of asset classes.
CLASS_ORDER = ("STANDARD", "SUB_STANDARD", "DOUBTFUL", "LOSS")


def class_order(name: str) -> Column:
    place = F.lit(len(CLASS_ORDER) + 1)
    for i, value in enumerate(CLASS_ORDER, 1):
        place = F.when(F.col(name) == value, i).otherwise(place)
    return place


def npa_breakdown(risk: DataFrame, day: str | None = None, branch: str | None = None) -> DataFrame:
    rows = _on_day(risk, scope.report_day(risk, day), branch)
    total = rows.agg(F.sum(_or_zero("BALANCE_OUTSTANDING"))).scalar()
    out = rows.groupBy("NPA_CLASSIFICATION").agg(
        F.count("ACCOUNT_NO").alias("ACCOUNT_COUNT"), F.sum(_or_zero("BALANCE_OUTSTANDING")).alias("TOTAL_OUTSTANDING"),
        F.sum(_or_zero("INCA")).alias("TOTAL_INCA"), F.sum(_or_zero("UIPY")).alias("TOTAL_UIPY"),
        F.sum(_or_zero("OVERDUE_INTEREST")).alias("TOTAL_OVERDUE_INTEREST"),
        F.sum(_or_zero("IRREGULAR_AMOUNT")).alias("TOTAL_IRREGULAR"),
        F.count_if("IS_PROBABLE_NPA").alias("PROBABLE_NPA_COUNT"), F.count_if("IS_CONFIRMED_NPA").alias("CONFIRMED_NPA_COUNT"),
    )
    percentage = F.try_divide(F.col("TOTAL_OUTSTANDING").cast("double") * 100, total.cast("double"))
    return out.select(
        F.coalesce("NPA_CLASSIFICATION", F.lit("UNCLASSIFIED")).alias("ASSET_CATEGORY"),
        *[c for c in out.columns if c != "NPA_CLASSIFICATION"], percentage.alias("PORTFOLIO_PERCENTAGE"),
    ).orderBy(class_order("ASSET_CATEGORY"), "ASSET_CATEGORY")


# Ageing slabs with their labels.
AGEING = {
    "ARREARS_1D_28D": "1D - 28D", "ARREARS_29D_3M": "29D - 3M", "ARREARS_3M_6M": "3M - 6M", "ARREARS_6M_1Y": "6M - 1Y",
    "ARREARS_1Y_3Y": "1Y - 3Y", "ARREARS_3Y_PLUS": "3Y+",
}


def arrears_ageing(risk: DataFrame, day: str | None = None) -> DataFrame:
    """One pass over the fact, then the six slabs as rows."""
    rows = _on_day(risk, scope.report_day(risk, day))
    wide = rows.agg(
        *[F.count_if(_or_zero(c) != 0).alias(f"n_{c}") for c in AGEING], *[F.sum(_or_zero(c)).alias(f"v_{c}") for c in AGEING])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("ARREARS_SLAB"), F.lit(i).alias("SORT_ORDER"), F.col(f"n_{c}").alias("ACCOUNT_COUNT"),
                 F.col(f"v_{c}").alias("TOTAL_ARREARS"))
        for i, (c, label) in enumerate(AGEING.items(), 1)
    ]))).orderBy("SORT_ORDER")


BRANCH_COLUMNS = ["BRANCH_CODE", "BRANCH_NAME", "REGIONAL_OFFICE_NAME", "DISTRICT"]


def _named(totals: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Totals per branch with the branch's names; joined after aggregation, when both sides are small."""
    return totals.join(hierarchy.select(*BRANCH_COLUMNS), "BRANCH_CODE", "left")


def _ranked(rows: DataFrame, hierarchy: DataFrame, totals: list[Column], measure: str, n: int,
            high: str = "TOP", low: str = "BOTTOM") -> DataFrame:
    by_branch = _named(rows.groupBy("BRANCH_CODE").agg(*totals), hierarchy)
    out = ranking.top_and_bottom(by_branch, measure, n, high, low)
    figures = [c for c in out.columns if c not in (*BRANCH_COLUMNS, "RANK_TOP", "RANKING_CATEGORY")]
    return out.select(*BRANCH_COLUMNS, *figures, "RANKING_CATEGORY", "RANK_TOP").orderBy("RANK_TOP", "BRANCH_CODE")


def branches_by_deposits(accounts: DataFrame, hierarchy: DataFrame, day: str | None = None, n: int = 10,
                         branch: str | None = None) -> DataFrame:
    rows = _on_day(accounts, scope.report_day(accounts, day), branch).filter("ACCOUNT_CATEGORY = 'DEPOSIT'")
    return _ranked(rows, hierarchy, [
        F.count("ACCOUNT_NO").alias("DEPOSIT_ACCOUNTS"), F.sum(_or_zero("CURRENT_BALANCE")).alias("TOTAL_DEPOSITS"),
        F.avg("INTEREST_RATE").alias("AVG_RATE")], "TOTAL_DEPOSITS", n)


def branches_by_advances(accounts: DataFrame, hierarchy: DataFrame, day: str | None = None, n: int = 10,
                         branch: str | None = None) -> DataFrame:
    """Loans and overdrafts by outstanding (overdrafts carry none, so they count as accounts only)."""
    rows = _on_day(accounts, scope.report_day(accounts, day), branch).filter(F.col("ACCOUNT_CATEGORY").isin("LOAN", "CC_OD"))
    return _ranked(rows, hierarchy, [
        F.count("ACCOUNT_NO").alias("LOAN_ACCOUNTS"), F.sum(_or_zero("OUTSTANDING")).alias("TOTAL_ADVANCES"),
        F.avg("INTEREST_RATE").alias("AVG_RATE")], "TOTAL_ADVANCES", n)


def branches_by_npa(risk: DataFrame, hierarchy: DataFrame, day: str | None = None, n: int = 10,
                    branch: str | None = None) -> DataFrame:
    rows = _on_day(risk, scope.report_day(risk, day), branch).filter("IS_CONFIRMED_NPA")
    grade = F.col("NPA_CLASSIFICATION")
    return _ranked(rows, hierarchy, [
        F.count("ACCOUNT_NO").alias("NPA_ACCOUNTS"), F.sum(_or_zero("BALANCE_OUTSTANDING")).alias("NPA_OUTSTANDING"),
        F.sum(_or_zero("INCA")).alias("TOTAL_INCA"), F.sum(_or_zero("UIPY")).alias("TOTAL_UIPY"),
        F.count_if(grade == "SUB_STANDARD").alias("SUB_STD_COUNT"), F.count_if(grade == "DOUBTFUL").alias("DOUBTFUL_COUNT"),
        F.count_if(grade == "LOSS").alias("LOSS_COUNT")], "NPA_OUTSTANDING", n, "TOP_NPA", "LEAST_NPA")
