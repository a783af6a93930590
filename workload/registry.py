"""Named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .standins import Tables, with_standins

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, standins: str = "", digits: int = 2):
    """Register a query. ``check`` is its SQL over given tables and the named stand-ins."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda t: present(fn(t), digits)
        if check:
            CHECKS[name] = with_standins(check, *standins.split())
        return fn

    return register


def present(df: DataFrame, digits: int = 2) -> DataFrame:
    """Plain result types: dates as ISO text, decimals and doubles as rounded doubles, integers as bigint."""

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), max(digits, 4))
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        return c.alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])
