"""The three readings of money text used by the dashboards, kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column) -> Column:
    return c.try_cast("double")


def comma_free(name: str) -> Column:
    """Commas removed, NULL read as 0; other text is NULL."""
    return _double(F.replace(F.coalesce(F.col(name), F.lit("0")), F.lit(","), F.lit("")))


def as_printed(name: str) -> Column:
    """No cleaning: a value with a comma is not a number."""
    return _double(F.col(name))


def blank_as_zero(name: str) -> Column:
    """NULL and empty text are 0; other text must be a number."""
    return _double(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("0")))


def sum_comma_free(name: str) -> Column:
    return F.sum(comma_free(name))


def sum_as_printed(name: str) -> Column:
    return F.sum(as_printed(name))


def numeric_else_zero(name: str) -> Column:
    return F.coalesce(_double(F.replace(F.col(name), F.lit(","), F.lit(""))), F.lit(0.0))


def screen_number(name: str) -> Column:
    """Magnitude shown on screen: separators and currency signs dropped, junk is 0."""
    return F.coalesce(F.abs(_double(F.translate(F.col(name), ",₹$ ", ""))), F.lit(0.0))


def sortable(name: str) -> Column:
    """Numeric order of text; NULL sorts as 0."""
    return _double(F.translate(F.coalesce(F.col(name), F.lit("0")), ",₹", ""))


def lakhs(c: Column) -> Column:
    return F.round(c / 1e5, 2)


def crores(c: Column) -> Column:
    return F.round(c / 1e7, 2)


def ratio(part: Column, whole: Column) -> Column:
    """Percentage, 0 when the whole is not positive."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
