from datetime import date
from decimal import Decimal

import pytest

from ledgerlake.functions import cleanse
from ledgerlake.functions.register import register

CASES = {
    "customer_id": [("0000123456789", "123456789"), ("  CIF-00456  ", "CIF00456"), (None, None), ("", None), ("000", "0"), ("--", None)],
    "account_no": [
        ("4020-0029-4534", "402000294534"), (" 00000809190003298 ", "00000809190003298"), ("402 000 294 534", "402000294534"), (None, None), ("", None)],
    "branch_code": [
        ("1", "00001"), ("7", "00007"), ("61", "00061"), ("00061", "00061"), (None, None), ("123456", "23456"), (" abc ", "abc"), ("B-7", "00007"), (" ", None)],
    "amount": [
        ("12,00,000.00-", Decimal("-1200000.00")), ("97,885.00+", Decimal("97885.00")), ("12,00,000.00", Decimal("1200000.00")),
        ("-322338.8", Decimal("-322338.80")), ("₹ 1,500.00", Decimal("1500.00")), ("0.00", Decimal("0.00")), ("", None), (None, None), ("N/A", None),
        ("n/a", None), ("1,500.00 CR", None), ("--5", Decimal("5.00")), ("-5-", Decimal("-5.00")), ("1.005", Decimal("1.01")), ("1e5", None), ("-", None),
        (".", None), ("$ 7", Decimal("7.00"))],
    "date": [
        ("28/10/2024", date(2024, 10, 28)), ("28-10-2024", date(2024, 10, 28)), ("28-OCT-24", date(2024, 10, 28)), ("28-oct-2024", date(2024, 10, 28)),
        ("2024-10-28", date(2024, 10, 28)), (None, None), ("", None), ("28-OCT-60", date(1960, 10, 28)), ("8/1/2024", date(2024, 1, 8)), ("31/02/2024", None),
        ("28-ANF-24", None), ("20241028", date(2024, 10, 28)), ("28-OCT-2150", None), ("10/2024", None), ("28/10/24", None)],
    "asset_class": [
        ("01 - SUB STANDARD", "SUB_STANDARD"), ("04", "LOSS"), ("3", "LOSS"), ("0", "STANDARD"), ("STANDARD", "STANDARD"), ("Sub-Std", "SUB_STANDARD"),
        ("doubtful-2", "DOUBTFUL"), ("", None), (None, None), ("odd one", "ODD ONE")],
    "account_status": [
        ("00", "00"), ("00 - OPEN", "OPEN"), ("clsd", "CLOSED"), ("DRMNT", "DORMANT"), ("FROZN", "FROZEN"), ("BLOCKED", "BLOCKED"), ("inoper", "INOPERATIVE"),
        ("", None), (None, None)],
    "rate": [("8.00 OPEN", Decimal("8.0000")), ("8.25", Decimal("8.2500")), ("x", None), ("", None), (None, None)],
    "whole_number": [("", 0), (" 4 ", 4), ("x", None), (None, None)],
}


@pytest.mark.parametrize("rule", CASES)
def test_golden_cases(spark, rule):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES[rule])], "i int, x string")
    got = [r[1] for r in rows.select("i", getattr(cleanse, rule)("x")).orderBy("i").collect()]
    assert got == [want for _, want in CASES[rule]]


def test_sql_names_agree_with_helpers(spark):
    register(spark)
    rows = spark.createDataFrame([(raw,) for raw, _ in CASES["amount"]], "x string")
    assert rows.selectExpr("clean_amount(x)").collect() == rows.select(cleanse.amount("x")).collect()


def test_status_falls_back_to_rate_text(spark):
    rows = spark.createDataFrame([("8.00 OPEN", ""), ("8.00 OPEN", "DORMANT"), ("8.00", None)], "r string, s string")
    assert [r[0] for r in rows.select(cleanse.rate_status("r", "s")).collect()] == ["OPEN", "DORMANT", None]
