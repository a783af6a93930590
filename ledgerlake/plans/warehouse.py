"""Load jobs: staging tables to warehouse tables, full or for one day, with a run log.

A load writes its rows once, into a folder of its own run, by date. Incomplete rows lie beside the others, as the
quarantine. Keys and codes are checked there, and only then is the run committed: one row appended to the table's commit log says
which run holds, wholly or for the days (and categories) that it covers. Readers take for each date the newest committed run, by a
filter on partition folders. So a load that fails at any point leaves the table as it was, two loads do not
meet in one folder, and a reader never sees half a load."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import lineage, quality
from ..session import tune
from ..sources import staging
from . import accounts, audit, branches, ledger, risk

BRANCHES, ACCOUNTS, RISK = "DIM_BRANCH_HIERARCHY", "FACT_ACCOUNT_SNAPSHOT", "FACT_LOAN_RISK_DELINQUENCY"
GL, AUDIT, OPENED, CLOSED = "FACT_GL_PRODUCT_SUMMARY", "FACT_AUDIT_EXCEPTIONS", "FACT_ACCOUNT_OPENED", "FACT_ACCOUNT_CLOSED"
RUN_LOG, COMMITS = "ETL_RUN_LOG", "_COMMITS"
RUN, STATE = "load_run", "load_state"
COMMIT_SCHEMA = "run string, covers string, row_schema string, rows bigint, committed_at timestamp"
LOG_SCHEMA = (
    "run_id string, procedure_name string, snapshot_date string, status string, rows_affected bigint, error_message string, "
    "started_at timestamp, completed_at timestamp"
)


class Warehouse:
    """Paths and writers of one warehouse root in shared storage."""

    def __init__(self, spark: SparkSession, staging_root: str, root: str):
        self.spark, self.staging_root, self.root = tune(spark), staging_root, root

    def _try_read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:
            return None

    def staged(self, names) -> dict[str, DataFrame]:
        """The staging tables that exist."""
        found = {}
        for name in names:
            try:
                found[name] = staging.read_staged(self.spark, self.staging_root, name)
            except AnalysisException:
                continue
        return found

    def commits(self, name: str) -> list:
        """The commits that still say something, newest first: none behind the newest one of the whole table, and of those that
        cover the same the newest."""
        log = self._try_read(f"{self.root}/{COMMITS}/{name}")
        if log is None:
            return []
        log = log.withColumn("order", F.row_number().over(Window.partitionBy("covers").orderBy(F.desc("committed_at"), "run")))
        out = []
        # One row for each day and category loaded since the last full load.
        for commit in log.filter("order = 1").orderBy(F.desc("committed_at"), "run").collect():
            out.append(commit)
            if not json.loads(commit.covers):
                break
        return out

    def _rows(self, name: str, state: str) -> DataFrame | None:
        found = self.commits(name)
        if not found:
            return None
        schema = T.StructType.fromJson(json.loads(found[0].row_schema))
        full = T.StructType([*schema.fields, T.StructField(RUN, T.StringType()), T.StructField(STATE, T.StringType())])
        holds = F.lit(None).cast("string")
        for commit in reversed(found):
            covered = F.lit(True)
            for column, values in json.loads(commit.covers).items():
                covered = covered & F.col(column).cast("string").isin(*values)
            holds = F.when(covered, F.lit(commit.run)).otherwise(holds)
        runs = [c.run for c in found]
        # The list of runs prunes folders without a look at the dates.
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}").filter(
            F.col(RUN).isin(*runs) & (F.col(STATE) == state) & (F.col(RUN) == holds)).drop(RUN, STATE)

    def table(self, name: str) -> DataFrame | None:
        """The committed rows; a table that no load has written is read as it is."""
        rows = self._rows(name, "complete")
        return self._try_read(f"{self.root}/{name}") if rows is None and not self._has_log(name) else rows

    def quarantine(self, name: str) -> DataFrame | None:
        """Rows that the loads which hold have left out, with the list of what they lack."""
        return self._rows(name, "broken")

    def _has_log(self, name: str) -> bool:
        return self._try_read(f"{self.root}/{COMMITS}/{name}") is not None

    def log(self, run: dict) -> None:
        self.spark.createDataFrame([run], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/{RUN_LOG}")

    def run_log(self) -> DataFrame:
        seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
        return self.table(RUN_LOG).withColumn("duration_seconds", seconds)

    # ------------------------------------------------------------ writing

    def publish(self, df: DataFrame | list[DataFrame], name: str, required: list[str], partitions: list[str] = (), covers: dict[str, list[str]] | None = None,
                keys: list[str] | None = None, codes: list[str] = (), check: Callable[[DataFrame], None] | None = None) -> int:
        """Write, check, commit; returns the number of complete rows. ``covers``: the values of partition columns that the load
        replaces, all if none. Duplicate keys or unknown codes stop the load before the commit. Neither the write nor a check
        leaves shuffle files behind. Of several frames, the rows of all make the load; they are written one after another, so that the
        disk holds the shuffle of one at a time."""
        with lineage.freed(self.spark):
            return self._published(df if isinstance(df, list) else [df], name, required, list(partitions), covers, keys, codes, check)

    def _published(self, parts: list[DataFrame], name: str, required: list[str], partitions: list[str], covers: dict[str, list[str]] | None,
                   keys: list[str] | None, codes: list[str], check: Callable[[DataFrame], None] | None) -> int:
        run = uuid.uuid4().hex
        missing = quality.missing_list(required)
        path = f"{self.root}/{name}/{RUN}={run}"
        for df in parts:
            rows = df.withColumn("missing", missing).withColumn(STATE, F.when(F.col("missing") == "", "complete").otherwise("broken"))
            spread = rows.hint("rebalance", STATE, *partitions) if partitions else rows
            spread.write.mode("append").partitionBy(STATE, *partitions).parquet(path)
        schema = T.StructType([*[f for f in rows.schema.fields if f.name not in (*partitions, STATE)], *[f for f in rows.schema.fields if f.name in partitions]])
        full = T.StructType([*schema.fields, T.StructField(STATE, T.StringType())])
        complete = self.spark.read.schema(full).parquet(path).filter(F.col(STATE) == "complete")
        if keys:
            quality.require_empty(quality.duplicate_keys(complete, keys), f"{name}: duplicate keys {keys}")
        for code in codes:
            quality.require_empty(quality.code_violations(complete, code), f"{name}: unknown {code}")
        if check:
            check(complete)
        count = complete.count()  # from the files' footers
        self.commit(name, run, covers or {}, schema, count)
        return count

    def commit(self, name: str, run: str, covers: dict[str, list[str]], schema: T.StructType, rows: int) -> None:
        """One file appended: the load is there or is not."""
        row = (run, json.dumps(covers, sort_keys=True), schema.json(), rows, datetime.now(timezone.utc))
        self.spark.createDataFrame([row], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/{COMMITS}/{name}")


def _day(day: str | None) -> dict[str, list[str]]:
    return {"SNAPSHOT_DATE": [day]} if day else {}


def _job(name: str, work: Callable[[Warehouse, str | None], int]):
    def run(w: Warehouse, day: str | None = None) -> int:
        entry = {"run_id": str(uuid.uuid4()), "procedure_name": name, "snapshot_date": day, "status": "RUNNING",
                 "rows_affected": None, "error_message": None, "started_at": datetime.now(timezone.utc), "completed_at": None}
        w.log(entry)
        try:
            rows = work(w, day)
        except Exception as e:
            w.log(entry | {"status": "FAILED", "error_message": str(e), "completed_at": datetime.now(timezone.utc)})
            raise
        w.log(entry | {"status": "SUCCESS", "rows_affected": rows, "completed_at": datetime.now(timezone.utc)})
        return rows

    return run


def _branches(w: Warehouse, day: str | None) -> int:
    merged = branches.load_hierarchy(w.table("BRANCH_NETWORK"), w.table(BRANCHES))
    return w.publish(merged, BRANCHES, ["BRANCH_CODE"], keys=["BRANCH_CODE"])


def _accounts(w: Warehouse, day: str | None) -> int:
    staged = w.staged(accounts.BUILDERS)
    if not staged:
        return 0
    # On a day, a category whose report is absent keeps its rows.
    covers = _day(day) | ({"ACCOUNT_CATEGORY": sorted(accounts.CATEGORY_OF[t] for t in staged)} if day else {})
    return w.publish(
        [accounts.account_snapshot({t: df}, day) for t, df in staged.items()], ACCOUNTS, ["SNAPSHOT_DATE", "ACCOUNT_NO", "BRANCH_CODE"], ["SNAPSHOT_DATE", "ACCOUNT_CATEGORY"], covers,
        ["SNAPSHOT_DATE", "ACCOUNT_NO", "ACCOUNT_CATEGORY"], ["ACCOUNT_CATEGORY"])


def _risk(w: Warehouse, day: str | None) -> int:
    staged = w.staged([*risk.PRECEDENCE, risk.DRAWING])
    if not any(t in staged for t in risk.PRECEDENCE):
        return 0

    def once(complete: DataFrame) -> None:
        quality.require_empty(complete.filter("copies > 1").select(*risk.KEYS, "copies"), f"{RISK}: duplicate keys {risk.KEYS}")

    return w.publish(
        risk.loan_risk(staged, day, with_copies=True), RISK, ["SNAPSHOT_DATE", "ACCOUNT_NO", "BRANCH_CODE"], ["SNAPSHOT_DATE"], _day(day), check=once)


def _ledger(w: Warehouse, day: str | None) -> int:
    staged = w.staged([ledger.TOTALS, ledger.BALANCES, ledger.FLOWS])
    if not staged:
        return 0
    return w.publish(ledger.gl_summary(staged, day), GL, ledger.KEYS, ["SNAPSHOT_DATE"], _day(day), ledger.KEYS)


def _audit(w: Warehouse, day: str | None) -> int:
    staged = w.staged(audit.BUILDERS)
    if not staged:
        return 0
    return w.publish([audit.audit_exceptions({t: df}, day) for t, df in staged.items()], AUDIT, ["SNAPSHOT_DATE", "BRANCH_CODE"], ["SNAPSHOT_DATE"], _day(day), codes=["EXCEPTION_TYPE", "SEVERITY"])


def _movement(source: str, target: str, build, date_column: str):
    def work(w: Warehouse, day: str | None) -> int:
        staged = w.staged([source])
        if not staged:
            return 0
        rows = staging.widen(staged[source], [date_column, "ACCOUNT_NUMBER", "ACCOUNT_NAME", "PRODUCT", "BALANCE"])
        return w.publish(build(rows), target, [date_column, "ACCOUNT_NO", "BRANCH_CODE"], codes=["ACCOUNT_CATEGORY"])

    return work


load_branches = _job("load_branches", _branches)
load_accounts = _job("load_accounts", _accounts)
load_risk = _job("load_risk", _risk)
load_ledger = _job("load_ledger", _ledger)
load_audit = _job("load_audit", _audit)
load_opened = _job("load_opened", _movement("ACCOUNT_OPENED_REPORT", OPENED, accounts.opened_accounts, "OPENED_DATE"))
load_closed = _job("load_closed", _movement("ACCOUNT_CLOSED_REPORT", CLOSED, accounts.closed_accounts, "CLOSED_DATE"))

DAILY = (load_branches, load_accounts, load_risk, load_ledger, load_audit)


def _sequence(jobs):
    def work(w: Warehouse, day: str | None) -> int:
        return sum(job(w, day) for job in jobs)

    return work


_full = _job("full_load", _sequence((*DAILY, load_opened, load_closed)))
_incremental = _job("incremental_load", _sequence(DAILY))


def full_load(w: Warehouse) -> int:
    """Every table, in order; the first failure stops the rest."""
    return _full(w, None)


def incremental_load(w: Warehouse, day: str) -> int:
    """Branches and the four daily facts for one day (opened and closed accounts are not part of it)."""
    if not day:
        raise ValueError("incremental_load needs a day")
    return _incremental(w, day)
