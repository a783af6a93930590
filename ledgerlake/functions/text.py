"""Small text helpers shared by the report readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report text is stripped of every ASCII blank, not only of spaces.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_TO_END = 2**31 - 1
# What a character class does not take literally.
_IN_CLASS = "\\^-[]&"


def _literal(chars) -> str:
    return "".join(f"\\{x}" if x in _IN_CLASS else x for x in chars)


def strip(c: Column) -> Column:
    # Plain spaces go first: Spark takes them off byte by byte, but looks each other blank up in the list.
    return F.btrim(F.trim(c), F.lit(BLANKS))


def cut(line: Column, start: int, end: int | None = None) -> Column:
    """Characters ``start`` (0-based) up to ``end`` (exclusive, or the line's end), stripped."""
    width = _TO_END if end is None else end - start
    return strip(F.substring(line, start + 1, width))


def has_any(c: Column, words) -> Column:
    """True where the text contains at least one of the words, taken literally. One pattern, so the text is worked out once, not once a word."""
    return c.rlike(f"(?=[{_literal(sorted({word[0] for word in words}))}])(?:" + "|".join(f"\\Q{word}\\E" for word in words) + ")")


def made_of(c: Column, chars: str) -> Column:
    """True where the text is non-empty and uses no character outside ``chars``; settled by the first other one."""
    return c.rlike(f"^[{_literal(chars)}]+\\z")


def digits_only(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def groups(c: Column, pattern: str, names) -> dict[str, Column]:
    """One column per capture group; empty text where the group took no part."""
    return {name: F.regexp_extract(c, pattern, i) for i, name in enumerate(names, start=1)}


def part(parts: Column, index: int) -> Column:
    """Array element (negative counts from the right), empty text when absent."""
    position = index + 1 if index >= 0 else index
    return F.coalesce(F.try_element_at(parts, F.lit(position)), F.lit(""))
