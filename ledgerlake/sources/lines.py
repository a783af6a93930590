"""Line-level cleaning shared by all layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_any, strip

# Texts that mark a line as page furniture, compared in upper case.
BOILERPLATE = (
    "JAMMU CENTRL CO-OPERATIVE BANK", "AREA:", "RUN DATE", "PROC DATE", "PROC-DATE", "BRANCH :",
    "BRANCH-NO:-", "BRANCH-NAME:-", "BRANCH NAME", "PAGE-NO: ", "PAGE NO", "PRODUCT CODE", "PRODUCT NAME",
    "CHECKER ID", "TELLER NAME", "REPORT ID", "MAKER ID", "CHECKED (SAY)", "ABSTRACT(YES)",
    "FOR APPARENT ERRORS", "HECKED BY :",
)


def is_boilerplate(line: Column) -> Column:
    return has_any(F.upper(line), BOILERPLATE)


def without_boilerplate(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_boilerplate(F.col("line")))


def grid_as_blanks(lines: DataFrame) -> DataFrame:
    """Grid characters become spaces; blank lines and ``===`` rules go.

    A plus sign after an amount is lost too.
    """
    flat = lines.withColumn("line", F.replace(F.replace("line", F.lit("|"), F.lit(" ")), F.lit("+"), F.lit(" ")))
    text = strip(F.col("line"))
    return flat.filter((text != "") & ~text.startswith("==="))


def to_lines(documents: DataFrame, path: str, text: str) -> DataFrame:
    """Whole texts to (path, line_no, line)."""
    return documents.select(
        F.col(path).cast("string").alias("path"), F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("line_no", "line")
    ).select("path", F.col("line_no").cast("bigint").alias("line_no"), "line")
