"""Which positions any line of a group has ink on, as bitmaps that merge.

A line is turned into words of 63 bits, one bit a position; words are joined by ``bit_or`` before and after the
shuffle. So a file of any length is spread over all tasks, and what is shuffled is a few longs a task and file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 63


def occupancy(lines: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    """``(keys, word, bits)`` of the positions that are not a space, the first position being the highest bit."""
    # One row a word, without arrays of words, so all of it is compiled; a character is looked at once.
    pieces = lines.select(*keys, F.col(line).alias("_line")).filter("_line <> ''").select(
        *keys, "_line", F.explode(F.sequence(F.lit(0), F.floor((F.length("_line") - 1) / BITS).cast("int"))).alias("word"))
    marks = F.replace(F.regexp_replace(F.substring("_line", F.col("word") * BITS + 1, F.lit(BITS)), "[^ ]", "1"), F.lit(" "), F.lit("0"))
    bits = F.conv(F.rpad(marks, BITS, "0"), 2, 10).cast("bigint")
    return pieces.select(*keys, "word", bits.alias("bits")).groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def ink(occupied: DataFrame, *keys: str) -> DataFrame:
    """``(keys, ink)``: one 0 or 1 for each position; as long as the widest line, in whole words."""
    words = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    gathered = occupied.groupBy(*keys).agg(words.alias("_words"), F.max("word").alias("_last"))
    word = lambda k: F.lpad(F.bin(F.coalesce(F.try_element_at("_words", k), F.lit(0).cast("bigint"))), BITS, "0")
    return gathered.select(*keys, F.array_join(F.transform(F.sequence(F.lit(0), F.col("_last")), word), "").alias("ink"))


def inked_count(occupied: DataFrame, *keys: str) -> DataFrame:
    """``(keys, inked)``: how many positions have ink."""
    return occupied.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("inked"))
