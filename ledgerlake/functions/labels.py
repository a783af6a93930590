"""Derived labels: categories, severities, deposit classes and display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Deposit status codes of the shadow file.
STATUS_LABELS = {
    "00": "Open",
    "01": "Dormant",
    "02": "Unclaimed",
    "03": "Inoperative",
    "07": "Closed",
    "11": "Inactive",
}


def product_category(name: str) -> Column:
    """Product codes starting with 6 are loans, every other code a deposit."""
    return F.when(F.col(name).startswith("6"), "LOAN").otherwise("DEPOSIT")


def lien_action(name: str) -> Column:
    tidy = F.trim(F.col(name))
    return F.when(F.upper(tidy) == "MARK", "MARK").when(F.upper(tidy) == "REM", "REMOVE").otherwise(tidy)


def is_casa(name: str) -> Column:
    c = F.col(name)
    return c.ilike("SB%") | c.ilike("CA%") | c.ilike("CURRENT%")


def is_term(name: str) -> Column:
    c = F.col(name)
    return c.ilike("%TDR%") | c.ilike("RD%") | c.ilike("%FDR%")


def deposit_status(name: str) -> Column:
    code = F.trim(F.col(name))
    label = F.lit("Others")
    for value, text in STATUS_LABELS.items():
        label = F.when(code == value, text).otherwise(label)
    return label


def display_name(c: Column, width: int = 15, missing: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(F.substring(c, 1, width), F.lit("")), F.lit(missing))


def category_volume() -> Column:
    """Deposits by current balance, loans by outstanding, overdrafts by magnitude."""
    kind = F.col("ACCOUNT_CATEGORY")
    return (
        F.when(kind == "DEPOSIT", F.coalesce("CURRENT_BALANCE", F.lit(0)))
        .when(kind == "LOAN", F.coalesce("OUTSTANDING", F.lit(0)))
        .when(kind == "CC_OD", F.abs(F.coalesce("CURRENT_BALANCE", F.lit(0))))
        .otherwise(F.lit(0))
    )


def book_balance() -> Column:
    """Current balance of deposits; elsewhere outstanding, else magnitude of the balance."""
    return F.when(
        F.col("ACCOUNT_CATEGORY") == "DEPOSIT", F.coalesce("CURRENT_BALANCE", F.lit(0))
    ).otherwise(F.coalesce(F.col("OUTSTANDING"), F.abs("CURRENT_BALANCE"), F.lit(0)))


def null_safe_sum(*columns: Column) -> Column:
    total = F.coalesce(columns[0], F.lit(0))
    for c in columns[1:]:
        total = total + F.coalesce(c, F.lit(0))
    return total


def _steps(value: Column, steps, otherwise: str) -> Column:
    label = F.lit(otherwise)
    for floor, name in sorted(steps):
        label = F.when(value >= floor, name).otherwise(label)
    return label


# Severity thresholds.
def breach_severity(value: Column) -> Column:
    return _steps(value, [(1000000, "CRITICAL"), (500000, "HIGH"), (100000, "MEDIUM")], "LOW")


def rate_gap(effective: Column, product: Column) -> Column:
    return F.abs(F.coalesce(effective, F.lit(0)) - F.coalesce(product, F.lit(0)))


def rate_severity(gap: Column) -> Column:
    return _steps(gap, [(2.0, "CRITICAL"), (1.0, "HIGH"), (0.5, "MEDIUM")], "LOW")


def large_txn_severity(value: Column) -> Column:
    return _steps(F.abs(F.coalesce(value, F.lit(0))), [(5000000, "CRITICAL"), (1000000, "HIGH")], "MEDIUM")


def lien_severity(value: Column) -> Column:
    return _steps(F.abs(F.coalesce(value, F.lit(0))), [(500000, "HIGH"), (100000, "MEDIUM")], "LOW")
