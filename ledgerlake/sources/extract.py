"""Extraction operators: lines of one layout to columns.

All take lines as (path, line_no, line) and keep ``path`` and ``line_no``. Everything is a native
column expression; state carried between lines comes from ``operators.ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut, digits_only, groups, has_any, made_of, part, strip
from ..operators import ordered
from .lines import without_boilerplate


def raw_line() -> Column:
    return F.col("line")


def bare_text() -> Column:
    return F.col("text")


Spans = dict[str, tuple[int, int | None]]


def spans(text: str) -> Spans:
    """``NAME:start-end`` entries; an open end runs to the end of the line."""
    out: Spans = {}
    for entry in text.split():
        name, limits = entry.split(":")
        start, end = limits.split("-")
        out[name] = (int(start), int(end) if end else None)
    return out


def printable(c: Column) -> Column:
    """No printer control character (tabs are fine)."""
    return ~c.rlike(r"[\x00-\x08\x0a-\x1f]")


def body(lines: DataFrame, marker: str | None = None, nth: int = 1, skip: Sequence[str] = (),
         skip_upper: Sequence[str] = (), rules: str | None = None, boilerplate: bool = False) -> DataFrame:
    """Detail lines with their stripped ``text``.

    ``marker``: characters of the rule line that opens the data (its ``nth`` occurrence); ``rules``:
    characters of rule lines to drop where nothing opens the data; ``skip``/``skip_upper``:
    words that disqualify a line; ``boilerplate``: keep page furniture.
    """
    rows = lines if boilerplate else without_boilerplate(lines)
    rows = rows.withColumn("text", strip(raw_line())).filter("text <> ''")
    if marker:
        rule = made_of(bare_text(), marker)
        rows = ordered.after_marker(rows, rule, nth).filter(~rule)
    elif rules:
        rows = rows.filter(~made_of(bare_text(), rules))
    if skip:
        rows = rows.filter(~has_any(bare_text(), skip))
    if skip_upper:
        rows = rows.filter(~has_any(F.upper(bare_text()), skip_upper))
    return rows


def sliced(rows: DataFrame, fields: Spans, keep: Sequence[str] = ()) -> DataFrame:
    """Fixed-width columns, each stripped."""
    columns = {name: cut(raw_line(), start, end) for name, (start, end) in fields.items()}
    return rows.select("path", "line_no", *keep, *[c.alias(n) for n, c in columns.items()])


def piped(rows: DataFrame, names: Sequence[str], first: int = 1, at_least: int | None = None,
          keep: Sequence[str] = (), source: Column | None = None) -> DataFrame:
    """Cells between pipes, starting at cell ``first`` of the split line."""
    cells = F.split(raw_line() if source is None else source, r"\|")
    wide = rows.withColumn("_cells", cells)
    if at_least:
        wide = wide.filter(F.size("_cells") >= at_least)
    return wide.select(
        "path", "line_no", *keep,
        *[strip(part(F.col("_cells"), first + i)).alias(n) for i, n in enumerate(names)],
    )


def matched(rows: DataFrame, pattern: str, names: Sequence[str], keep: Sequence[str] = (),
            source: Column | None = None) -> DataFrame:
    """Rows matching a pattern, one column per group, stripped."""
    source = bare_text() if source is None else source
    found = {n: strip(c) for n, c in groups(source, pattern, names).items()}
    return rows.filter(source.rlike(pattern)).select("path", "line_no", *keep, *[c.alias(n) for n, c in found.items()])


def gaps(rows: DataFrame, names: Sequence[str], at_least: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Cells separated by two or more blanks, from the left."""
    wide = rows.withColumn("_parts", F.split(bare_text(), r"\s{2,}")).filter(F.size("_parts") >= at_least)
    return wide.select(
        "path", "line_no", *keep, *[part(F.col("_parts"), i).alias(n) for i, n in enumerate(names)]
    )


def without_titles(rows: DataFrame, key: str, words: Sequence[str] = ("TOTAL",)) -> DataFrame:
    """Drops left-over headers: no key, a nil report, or a title word in the key."""
    k = F.col(key)
    return rows.filter((k != "") & ~k.startswith("NIL REPORT") & ~has_any(F.upper(k), words))


def fixed_width(fields: str, marker: str = "-_", nth: int = 2, key: str | None = None, skip: Sequence[str] = (),
                skip_upper: Sequence[str] = (), titles: Sequence[str] = ("TOTAL",)):
    """Layout: slices below a rule line, left-over headers dropped by their key column."""
    limits = spans(fields)

    def parse(lines: DataFrame) -> DataFrame:
        rows = sliced(body(lines, marker, nth, skip, skip_upper), limits)
        return without_titles(rows, key, titles) if key else rows

    return parse


def row_pattern(pattern: str, fields: str, marker: str | None = None, rules: str | None = None,
                skip: Sequence[str] = (), skip_upper: Sequence[str] = (), on_line: bool = False):
    """Layout: one pattern per row."""
    names = fields.split()

    def parse(lines: DataFrame) -> DataFrame:
        rows = body(lines, marker, 1, skip, skip_upper, rules)
        return matched(rows, pattern, names, source=raw_line() if on_line else bare_text())

    return parse


def carried(rows: DataFrame, values: dict[str, Column], default: str = "") -> DataFrame:
    """Section headers filled down; ``default`` above the first one."""
    filled = ordered.carry_forward(rows, values)
    return filled.withColumns({n: F.coalesce(F.col(n), F.lit(default)) for n in values})


def between(rows: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Lines inside on/off sections, the opening lines excluded."""
    state = F.when(opens, F.lit(True)).when(closes, F.lit(False))
    return ordered.carry_forward(rows, {"_inside": state}).filter(F.col("_inside") & ~opens).drop("_inside")


def letter(keys: dict[str, tuple[Column, Column]], lines: DataFrame) -> DataFrame:
    """One row per file: for each field (condition, value), the value on the last line that has it."""
    rows = lines.withColumn("text", strip(raw_line()))
    wide = rows.groupBy("path").agg(
        F.lit(0).cast("bigint").alias("line_no"),
        *[F.max_by(value, F.when(found, F.col("line_no"))).alias(n) for n, (found, value) in keys.items()],
    )
    return wide.select("path", "line_no", *[F.coalesce(n, F.lit("")).alias(n) for n in keys])


def after(text: Column, key: str) -> Column:
    """Text with the key phrase taken out, stripped."""
    return strip(F.replace(text, F.lit(key), F.lit("")))


def last_piece(text: Column, separator: str = ":") -> Column:
    return strip(F.substring_index(text, separator, -1))


def padded(code: Column) -> Column:
    """Zero-padded to five digits; longer codes stay whole."""
    return F.when(F.length(code) < 5, F.lpad(code, 5, "0")).otherwise(code)


def table_name(lines: DataFrame) -> DataFrame:
    """(path, table_name) from the title: the first of 15 lines with REPORT and over ten characters."""
    text = strip(F.upper(raw_line()))
    name = text
    for pattern in (r"\d{2}/\d{2}/\d{4}", "AS ON", r"PAGE-NO\s*\d+", r"REPORT ID\s*:\s*[A-Z0-9-]+"):
        name = F.regexp_replace(name, pattern, "")
    name = F.btrim(F.regexp_replace(strip(name), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    titled = (F.col("line_no") < 15) & text.contains("REPORT") & (F.length(text) > 10)
    return lines.groupBy("path").agg(
        F.coalesce(F.min_by(name, F.when(titled, F.col("line_no"))), F.lit("UNKNOWN_TABLE")).alias("table_name")
    )


def table_from_file(name: Column) -> Column:
    """Table name from a file name: extension off, upper case, other characters to single underscores."""
    base = F.upper(F.regexp_replace(name, r"(\.txt\.gz|\.gz|\.txt|\.csv)$", ""))
    return F.btrim(F.regexp_replace(F.regexp_replace(base, "[^A-Z0-9_]", "_"), "_+", "_"), F.lit("_"))


