"""Texts cut into pieces with their places, and columns read off them, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

OPEN_END = 10**9
PIECES = "array<struct<start:int,end:int,piece:string>>"
NAMED = "array<struct<name:string,start:int,end:int>>"


def pieces(text: Column, pattern: str) -> Column:
    """``(start, end, piece)`` of each match in order; the pattern must take in every character."""

    def add(done: Column, piece: Column) -> Column:
        end = done["at"] + F.length(piece)
        one = F.struct(done["at"].alias("start"), end.alias("end"), piece.alias("piece"))
        return F.struct(end.alias("at"), F.array_append(done["out"], one).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(PIECES).alias("out"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), start, add, lambda done: done["out"])


def _where(found: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(found, lambda p: test(p["piece"]))


def dash_runs(rule: Column) -> Column:
    return _where(pieces(F.rtrim(rule), "-+|[^-]+"), lambda p: p.startswith("-"))


def ink_runs(ink: Column) -> Column:
    """Runs of occupied positions in a text of 0 and 1."""
    return _where(pieces(ink, "0+|1+"), lambda p: p.startswith("1"))


def starts(found: Column) -> Column:
    return F.transform(found, lambda p: p["start"])


def pipes(text: Column, marks: str = "|") -> Column:
    """Places of the grid characters."""
    return starts(_where(pieces(text, f"[{marks}]|[^{marks}]+"), lambda p: p.rlike(f"^[{marks}]")))


def cell_starts(title: Column) -> Column:
    """Columns of a piped title line begin at 0 and behind each pipe with text to its right."""
    behind = F.transform(pipes(title), lambda p: p + 1)
    return F.filter(F.concat(F.array(F.lit(0)), behind), lambda m: m < F.length(F.rtrim(title)))


def gap_ends(title: Column) -> Column:
    """The last blank of each run of two or more: the column to its right begins there."""
    return F.transform(_where(pieces(title, " +|[^ ]+"), lambda p: p.startswith("  ")), lambda p: p["end"] - 1)


def spans(marks: Column) -> Column:
    """Columns from each mark to the next, the last one open."""
    return F.transform(marks, lambda m, i: F.struct(m.alias("start"), F.coalesce(F.get(marks, i + 1), F.lit(OPEN_END)).alias("end")))


def opened(columns: Column) -> Column:
    """The last column runs to the end of the line."""
    last = F.size(columns) - 1
    return F.transform(columns, lambda c, i: F.struct(c["start"].alias("start"), F.when(i == last, OPEN_END).otherwise(c["end"]).alias("end")))


def under(line: Column, column: Column) -> Column:
    """What a line has in a column, stripped."""
    return strip(F.substring(line, column["start"] + 1, column["end"] - column["start"]))


def tidy(text: Column) -> Column:
    """Letters and digits, all else one underscore; may be empty."""
    return F.upper(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def or_else(text: Column, other: Column | str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), other if isinstance(other, Column) else F.lit(other))


def titled(columns: Column, titles: Column) -> Column:
    """Each column named by what all title lines have there, joined from the top; COL_n where they have nothing."""

    def name(column: Column, i: Column) -> Column:
        parts = F.filter(F.transform(titles, lambda line: under(line, column)), lambda p: p != "")
        return or_else(tidy(F.array_join(parts, "_")), F.concat(F.lit("COL_"), i.cast("string")))

    return F.transform(columns, lambda c, i: F.struct(name(c, i).alias("name"), c["start"].alias("start"), c["end"].alias("end")))


def unrepeated(columns: Column) -> Column:
    """Repeated names get _1, _2, ... in order of appearance."""

    def add(done: Column, column: Column) -> Column:
        taken = F.transform(done, lambda c: c["name"])
        numbered = F.transform(F.sequence(F.lit(1), F.size(done) + 1), lambda k: F.concat(column["name"], F.lit("_"), k.cast("string")))
        free = F.get(F.filter(F.concat(F.array(column["name"]), numbered), lambda n: ~F.array_contains(taken, n)), F.lit(0))
        return F.array_append(done, F.struct(free.alias("name"), column["start"].alias("start"), column["end"].alias("end")))

    return F.aggregate(columns, F.array().cast(NAMED), add)
