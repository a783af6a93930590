import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import joining, ordered, profiling, quality, ranking, scope, security


def test_carry_forward_matches_sequential_scan(spark):
    rng = random.Random(7)
    data = [("hot", i, rng.choice(["H%d" % i, None, None, None])) for i in range(500)] + [("b", i, None) for i in range(5)]
    rows = spark.createDataFrame(data, "path string, line_no bigint, head string")
    got = {(r.path, r.line_no): r.v for r in ordered.carry_forward(rows, {"v": F.col("head")}, block_lines=16).collect()}
    last = {}
    for path, n, head in data:
        last[path] = head if head is not None else last.get(path)
        assert got[(path, n)] == last[path]


def test_after_nth_marker_and_records(make_lines):
    rows = make_lines({"a": ["x", "--", "y", "--", "1", "2"], "b": ["--", "z"]})
    assert [r.line for r in ordered.after_marker(rows, F.col("line") == "--", 2).orderBy("line_no").collect()] == ["1", "2"]
    numbered = ordered.records(rows, F.col("line") == "--", block_lines=2)
    assert {(r.path, r.line_no): r.record for r in numbered.collect()}[("a", 5)] == 3


def test_contained_codes_is_exact(spark):
    rng = random.Random(3)
    classes = ["".join(rng.choice("AB1") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    products = ["".join(rng.choice("ab1") for _ in range(rng.randint(0, 3))) for _ in range(30)] + [None]
    got = {tuple(r) for r in joining.contained_codes(
        spark.createDataFrame([(c,) for c in classes], "GL_CLASS_CODE string"),
        spark.createDataFrame([(p,) for p in products], "PROD_CODE string")).select("GL_CLASS_CODE", "PROD_CODE").collect()}
    assert got == {(c, p) for c in classes for p in products if p is not None and p.upper() in c.upper()}


def test_upsert_keeps_old_flags_and_rows(spark):
    old = spark.createDataFrame([("1", "a", False), ("2", "b", False)], "k string, v string, active boolean")
    new = spark.createDataFrame([("2", "B", True), ("3", "c", True)], "k string, v string, active boolean")
    got = {tuple(r) for r in joining.upsert(old, new, ["k"], ["v"]).collect()}
    assert got == {("1", "a", False), ("2", "B", False), ("3", "c", True)}


def test_update_from_lets_null_overwrite(spark):
    current = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    source = spark.createDataFrame([("1", None)], "k string, v string")
    assert {tuple(r) for r in joining.update_from(current, source, ["k"], {"v": F.col("s.v")}).collect()} == {("1", None), ("2", "b")}


def test_top_with_others_variants(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", -9.0), ("c", 3.0), ("d", 1.0)], "name string, v double")

    def run(**kw):
        return {r.name: r.v for r in ranking.top_with_others(rows, "name", "v", 2, **kw).collect()}

    assert run() == {"a": 5.0, "c": 3.0, "Others": -8.0}
    assert run(positive_only=True) == {"a": 5.0, "c": 3.0}
    assert run(by_magnitude=True, label="Other Branches") == {"b": -9.0, "a": 5.0, "Other Branches": 4.0}
    assert run(spare=2) == {"a": 5.0, "b": -9.0, "c": 3.0, "d": 1.0}


def test_ties_stay_in_top_and_bottom(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", 1)], "n string, v int")
    got = {(r.n, r.RANK_TOP, r.RANKING_CATEGORY) for r in ranking.top_and_bottom(rows, "v", 1).collect()}
    assert got == {("a", 1, "TOP"), ("b", 1, "TOP"), ("d", 4, "BOTTOM")}


def test_period_and_search_rules(spark):
    rows = spark.createDataFrame([("01/01/2024", "5% off"), ("10/01/2024", "plain"), ("bad", "50 off")], "PROC_DATE string, t string")
    assert scope.in_period(rows, "7D").count() == 1
    assert scope.in_period(rows, "15D").count() == 2
    assert scope.in_period(rows, "all_time").count() == 3
    assert scope.in_period(rows, "ALL", table="LIST_OF_NPA_ACCOUNTS").count() == 1
    assert [r.t for r in scope.search(rows, "5%", ["t"]).collect()] == ["5% off"]


@pytest.mark.parametrize("user, seen", [
    (None, {"1", "2", "3"}), ("ho", {"1", "2", "3"}), ("ro", {"1", "2"}), ("both", {"2", "3"}), ("left", set()), ("nobody", set())])
def test_row_security(spark, user, seen):
    access = spark.createDataFrame([
        ("ho", "HO", None, None, True), ("ro", "RO", None, "RO01", True), ("both", "BRANCH", "3", None, True), ("both", "BRANCH", "2", None, True),
        ("left", "BRANCH", "1", None, False)], "USER_LOGIN string, ACCESS_ROLE string, BRANCH_CODE string, REGIONAL_OFFICE_CODE string, IS_ACTIVE boolean")
    branches = spark.createDataFrame([("1", "RO01"), ("2", "RO01"), ("3", "RO02")], "BRANCH_CODE string, REGIONAL_OFFICE_CODE string")
    facts = spark.createDataFrame([("1",), ("2",), ("3",)], "BRANCH_CODE string")
    assert {r.BRANCH_CODE for r in security.secure(facts, access, branches, user).collect()} == seen


def test_quality_frames(spark):
    rows = spark.createDataFrame([("a", "LOW"), ("a", "ODD"), (None, None)], "k string, SEVERITY string")
    assert [(r.value, r.rows) for r in quality.code_violations(rows, "SEVERITY").collect()] == [("ODD", 1)]
    assert quality.duplicate_keys(rows, ["k"]).count() == 1
    assert [r.missing for r in quality.missing_values(rows, ["k", "SEVERITY"]).collect()] == ["k,SEVERITY"]
    with pytest.raises(quality.LoadRejected):
        quality.require_empty(quality.duplicate_keys(rows, ["k"]), "t")


def test_column_metrics_threshold(spark):
    rows = spark.createDataFrame([(str(i), "x" if i else "1", "n%d" % (i % 3)) for i in range(20)], "AMT string, RARE string, NAME string")
    got = {(r.column_name, r.kind, r.total) for r in profiling.column_metrics(rows).collect()}
    assert got == {("AMT", "sum", 190.0), ("NAME", "distinct", 3.0)}
