from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.quality import LoadRejected
from ledgerlake.plans import accounts, ledger, risk, warehouse
from workload.standins import Tables
from workload.loads import ACCOUNT_SOURCES, RISK_SOURCES, staged

FOLDER = "/root/testdata/sf0.001"


def _statement(spark, rows):
    columns = "PROC_DATE ACCT_NO CUST_NO NAME BRANCH_CODE BR_NO PROD_DESCRIPTION SYS NI OI NPA_DATE LST_ARR_D BAL_OUTSTAND OVERDUE_INT INCA UIPY IRR_AMT REPORT_ID".split()
    return spark.createDataFrame([[r.get(c, "") for c in columns] for r in rows], ", ".join(f"{c} string" for c in columns))


def _drawing(spark, account):
    row = [("28/04/2025", account, "9.00", "1.00", "77.00", "B", "T")]
    return spark.createDataFrame(row, "PROC_DATE string, ACCOUNT_NO string, DRAWING_POWER string, ACTUAL_VARIANCE string, OUTSTANDING string, "
                                      "BENCHMARK_LEVEL string, TOLERANCE_LEVEL string").withColumns({"BRANCH_CODE": F.lit("1"), "REPORT_ID": F.lit("x")})


def test_branch_of_statement_falls_back_only_for_null(spark):
    rows = _statement(spark, [
        {"ACCT_NO": "1", "PROC_DATE": "28/04/2025", "BRANCH_CODE": None, "BR_NO": "7"}, {"ACCT_NO": "2", "PROC_DATE": "28/04/2025", "BRANCH_CODE": "", "BR_NO": "7"}])
    got = {r.ACCOUNT_NO: r.BRANCH_CODE for r in risk.from_statement(rows).collect()}
    assert got == {"1": "00007", "2": None}


def test_drawing_power_skips_later_reports(spark):
    late = spark.createDataFrame([("28/04/2025", "5", "n", "1", "d", "1.00", "2.00", "0", "0", "r")],
                                 "PROC_DATE string, ACCOUNT_NO string, NAME_OF_BORROWER string, BRANCH_CODE string, DESCRIPT string, OUTSTANDING string, "
                                 "IRREGULARITY string, OLD_BAD_IND string, NEW_BAD_IND string, REPORT_ID string")
    early = _statement(spark, [{"ACCT_NO": "6", "PROC_DATE": "28/04/2025", "BRANCH_CODE": "1"}])
    power = _drawing(spark, "5").union(_drawing(spark, "6"))
    got = {r.ACCOUNT_NO: (r.DRAWING_POWER, r.OUTSTANDING) for r in risk.loan_risk({risk.STATEMENT: early, risk.IRREGULAR: late, risk.DRAWING: power}).collect()}
    assert got["5"][0] is None and float(got["5"][1]) == 1.0
    assert float(got["6"][0]) == 9.0 and float(got["6"][1]) == 77.0


def test_copies_are_counted_in_the_chosen_report_only(spark):
    rows = _statement(spark, [{"ACCT_NO": "1", "PROC_DATE": "28/04/2025", "BRANCH_CODE": "1"}] * 2)
    got = risk.loan_risk({risk.STATEMENT: rows}, with_copies=True).collect()
    assert [r.copies for r in got] == [2]


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_each_risk_report_is_read_once_and_meets_in_one_shuffle(spark, tmp_path):
    for name, rows in {risk.STATEMENT: _statement(spark, [{"ACCT_NO": "6", "PROC_DATE": "28/04/2025", "BRANCH_CODE": "1"}]), risk.DRAWING: _drawing(spark, "6")}.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    found = risk.loan_risk({n: spark.read.parquet(f"{tmp_path}/{n}") for n in (risk.STATEMENT, risk.DRAWING)}, with_copies=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert _scans(found) == 2 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, plan
    assert [(float(r.DRAWING_POWER), r.copies) for r in found.collect()] == [(9.0, 1)]


def test_foremost_row_and_greatest_update_by_value(spark):
    rows = _statement(spark, [
        {"ACCT_NO": "6", "PROC_DATE": "28/04/2025", "BRANCH_CODE": "1", "NAME": n} for n in ("B", "A", None)])
    power = _drawing(spark, "6").union(_drawing(spark, "6").withColumns({"DRAWING_POWER": F.lit("9.50"), "OUTSTANDING": F.lit(None).cast("string")})).union(
        _drawing(spark, "6").withColumn("DRAWING_POWER", F.lit(None).cast("string"))).union(_drawing(spark, "7"))
    got = risk.loan_risk({risk.STATEMENT: rows, risk.DRAWING: power}, with_copies=True).collect()
    assert [(r.ACCOUNT_NO, r.CUSTOMER_NAME, float(r.DRAWING_POWER), r.OUTSTANDING, r.copies) for r in got] == [("6", None, 9.5, None, 3)]


def test_each_ledger_report_is_read_once(spark, tmp_path, monkeypatch):
    from ledgerlake.operators import lineage

    t = Tables(spark, FOLDER)
    read, settled = [], lineage.settled
    monkeypatch.setattr(lineage, "settled", lambda df: (read.append(_scans(df)), settled(df))[1])
    out = ledger.gl_summary(staged(t, "gl_totals", "gl_balances", "flows"))
    assert sum(read) + _scans(out) == 3 and out.count() > 0


def test_ledger_rows_are_added_up_without_a_sort(spark):
    made = [("28/04/2025", "1", "C", "1", n, "1.50", r) for n, r in (("B ", "r2"), ("A", "r1"), (None, None))]
    rows = spark.createDataFrame(made, "PROC_DATE string, BRANCH_CODE string, PROD_CODE string, ACCOUNT_NO string, PROD_DESC string, CASH_CREDIT string, REPORT_ID string")
    found = ledger.daily_flows(rows.withColumns({c: F.lit("") for c in ledger.FLOW_COLUMNS if c != "CASH_CREDIT"}))
    deepest = found._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]
    assert "HashAggregate" in deepest and "Sort" not in deepest, deepest
    assert [(r.PRODUCT_NAME, r.ACCOUNT_COUNT, float(r.DAILY_CASH_CREDIT), r.DAILY_CASH_DEBIT, r.SOURCE_REPORT_ID) for r in found.collect()] == [("B", 3, 4.5, None, "r1")]


def test_longest_product_code_wins(spark):
    totals = spark.createDataFrame([("28/04/2025", "1", "X12Y", "n", "1", "5.00", "0", "0", "0", "0", "r")],
                                   "PROC_DATE string, BRANCH_CODE string, GL_CLASS_CODE string, NAME string, ACT_TOTAL string, TOTAL_AMOUNT string, TOTAL_INTEREST string, "
                                   "TOTAL_DR_OD_INT string, TOTAL_UNCLEARED_AMT string, TOTAL_COLLECTION_AMT string, REPORT_ID string")
    flows = spark.createDataFrame([("28/04/2025", "1", "a", c, "d", v, "r") for c, v in [("1", "1.00"), ("12", "2.00"), ("", "3.00"), ("X12Y", "4.00"), ("ZZ", "5.00")]],
                                  "PROC_DATE string, BRANCH_CODE string, ACCOUNT_NO string, PROD_CODE string, PROD_DESC string, CASH_CREDIT string, REPORT_ID string")
    for c in ledger.FLOW_COLUMNS:
        if c != "CASH_CREDIT":
            flows = flows.withColumn(c, F.lit(""))
    got = {(r.GL_CLASS_CODE, r.SOURCE_TABLE): float(r.DAILY_CASH_CREDIT) for r in ledger.gl_summary({ledger.TOTALS: totals, ledger.FLOWS: flows}).collect()}
    # A product contained in a longer class is both taken over and inserted.
    assert got[("X12Y", ledger.TOTALS)] == 4.0 and {k[0] for k in got if k[1] == "GNBD7376"} == {"1", "12", "", "ZZ"}


@pytest.fixture
def house(spark, tmp_path):
    t = Tables(spark, FOLDER)
    for table, df in {**staged(t, *ACCOUNT_SOURCES.split()), **staged(t, *RISK_SOURCES.split())}.items():
        df.write.parquet(f"{tmp_path}/stage/{table}")
    t("network").write.parquet(f"{tmp_path}/dw/BRANCH_NETWORK")
    return warehouse.Warehouse(spark, f"{tmp_path}/stage", f"{tmp_path}/dw")


def _content(w, name):
    df = w.table(name)
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def test_loads_are_repeatable_and_days_are_replaced(house):
    warehouse.full_load(house)
    before = {n: _content(house, n) for n in (warehouse.BRANCHES, warehouse.ACCOUNTS, warehouse.RISK)}
    warehouse.incremental_load(house, "2025-04-28")
    assert before == {n: _content(house, n) for n in before}
    log = house.run_log().filter("status <> 'RUNNING'")
    assert {r.status for r in log.collect()} == {"SUCCESS"}
    days = {r[0] for r in house.table(warehouse.ACCOUNTS).select("SNAPSHOT_DATE").distinct().collect()}
    assert days == {date(2025, 3, 31), date(2025, 4, 15), date(2025, 4, 28)}


def test_duplicate_keys_stop_the_load(house, spark):
    warehouse.load_accounts(house)
    before = _content(house, warehouse.ACCOUNTS)
    table = f"{house.staging_root}/{accounts.OVERDRAFTS}"
    spark.read.parquet(table).write.mode("append").parquet(table)
    with pytest.raises(LoadRejected):
        warehouse.load_accounts(house)
    assert _content(house, warehouse.ACCOUNTS) == before
    assert house.run_log().filter("status = 'FAILED'").count() == 1


def test_incremental_needs_a_day(house):
    with pytest.raises(ValueError):
        warehouse.incremental_load(house, "")


def test_a_load_that_fails_before_its_commit_changes_nothing(house, spark, monkeypatch):
    warehouse.full_load(house)
    before = _content(house, warehouse.ACCOUNTS)

    def lost(*_):
        raise RuntimeError("lost between write and commit")

    with monkeypatch.context() as m:
        m.setattr(house, "commit", lost)
        with pytest.raises(RuntimeError):
            warehouse.load_accounts(house, "2025-04-28")
    assert _content(house, warehouse.ACCOUNTS) == before
    reader = house.table(warehouse.ACCOUNTS)
    warehouse.load_accounts(house, "2025-04-28")
    assert sorted(str(r) for r in reader.select(*sorted(reader.columns)).collect()) == before  # a reader that began before the commit


def test_a_day_load_replaces_its_categories_only(house, spark, tmp_path):
    warehouse.load_accounts(house)
    rows = house.table(warehouse.ACCOUNTS).filter("SNAPSHOT_DATE = '2025-04-28'")
    loans = rows.filter("ACCOUNT_CATEGORY = 'LOAN'").count()
    one = spark.read.parquet(f"{house.staging_root}/{accounts.DEPOSITS}").filter("PROC_DATE = '28/04/2025'").orderBy("ACCOUNT_NUMBER").limit(1)
    one.write.parquet(f"{tmp_path}/small/{accounts.DEPOSITS}")
    part = warehouse.Warehouse(spark, f"{tmp_path}/small", house.root)
    assert warehouse.load_accounts(part, "2025-04-28") == 1
    after = part.table(warehouse.ACCOUNTS).filter("SNAPSHOT_DATE = '2025-04-28'")
    assert after.filter("ACCOUNT_CATEGORY = 'DEPOSIT'").count() == 1 and after.filter("ACCOUNT_CATEGORY = 'LOAN'").count() == loans > 0
    one.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/small/{accounts.DEPOSITS}")
    assert warehouse.load_accounts(part, "2025-04-28") == 0
    assert part.table(warehouse.ACCOUNTS).filter("SNAPSHOT_DATE = '2025-04-28' and ACCOUNT_CATEGORY = 'DEPOSIT'").count() == 0


def test_incomplete_rows_are_set_aside(house, spark, tmp_path):
    rows = _statement(spark, [{"ACCT_NO": "1", "PROC_DATE": "28/04/2025", "BRANCH_CODE": "1"}, {"ACCT_NO": "2", "PROC_DATE": "28/04/2025", "BRANCH_CODE": ""}])
    rows.write.parquet(f"{tmp_path}/odd/{risk.STATEMENT}")
    odd = warehouse.Warehouse(spark, f"{tmp_path}/odd", f"{tmp_path}/odd_dw")
    assert warehouse.load_risk(odd) == 1
    assert [(r.ACCOUNT_NO, r.missing) for r in odd.quarantine(warehouse.RISK).collect()] == [("2", "BRANCH_CODE")]


def test_dashboards_read_only_their_day(house):
    from ledgerlake.plans import dashboards

    warehouse.load_accounts(house)
    plan = dashboards.business_mix(house.table(warehouse.ACCOUNTS))._jdf.queryExecution().executedPlan().toString()
    # The newest day, a subquery, is a partition filter of the scan: no filter is left above it.
    assert "isnotnull(SNAPSHOT_DATE" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "Subquery" in plan and "Filter (" not in plan, plan


def test_a_fact_lays_out_only_the_tables_it_loads(spark, tmp_path):
    import os

    from workload import loads
    from workload.standins import Tables

    made = {
        "region": "select 1L as r_regionkey, 'ASIA' as r_name", "nation": "select 1L as n_nationkey, 1L as n_regionkey, 'N_1' as n_name",
        "customer": "select 1L as c_custkey, 'A' as c_name, 1L as c_nationkey, 'BUILDING' as c_mktsegment, 5.0D as c_acctbal",
        "supplier": "select 1L as s_suppkey, 'S' as s_name, 1L as s_nationkey, 5.0D as s_acctbal",
        "orders": "select 1L as o_orderkey, 1L as o_custkey, 'F' as o_orderstatus, 9.0D as o_totalprice, timestamp '1996-01-02' as o_orderdate, '5-LOW' as o_orderpriority",
    }
    for name, text in made.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    assert loads.fact(t, warehouse.ACCOUNTS).count() == 3
    folder = t.staging().removeprefix("file://")
    assert sorted(n for n in os.listdir(folder) if not n.startswith(".")) == sorted(loads._TABLES[n] for n in loads.ACCOUNT_SOURCES.split())


def test_reports_of_a_load_are_written_one_after_another(spark, tmp_path, monkeypatch):
    """Each report of an account or audit load is a write of its own, and its shuffle files go when it ends."""
    from ledgerlake.operators import lineage, quality

    t, sources = Tables(spark, FOLDER), ("breaches", "large", "liens")
    for table, df in staged(t, *ACCOUNT_SOURCES.split(), *sources).items():
        df.write.parquet(f"{tmp_path}/stage/{table}")
    w, seen, kept = warehouse.Warehouse(spark, f"{tmp_path}/stage", f"{tmp_path}/dw"), [], quality.missing_list
    monkeypatch.setattr(quality, "missing_list", lambda required: (seen.append(spark.conf.get(lineage.FREED, "false")), kept(required))[1])
    before = spark.conf.get(lineage.FREED, "false")
    assert warehouse.load_accounts(w) == sum(t(n).count() for n in ACCOUNT_SOURCES.split())
    assert warehouse.load_audit(w) == sum(t(n).count() for n in sources)
    assert seen == ["true", "true"] and spark.conf.get(lineage.FREED, "false") == before
    for name, n in ((warehouse.ACCOUNTS, 3), (warehouse.AUDIT, 3)):
        files = w.table(name).inputFiles()
        assert len({f.rsplit("/", 1)[-1].split("-")[2] for f in files}) == n  # a job each
