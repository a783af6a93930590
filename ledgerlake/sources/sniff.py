"""What an unknown file looks like: profile, delimiter, structure, class, batch reports.

Whole files are profiled. Every step is an aggregate keyed by file (and delimiter or length), so
a huge file is reduced where its lines are before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .files import file_name
from ..operators import occupancy

# Candidate delimiters, in order of preference, and the scoring weights.
DELIMITERS = ("|", "==", "\t", ",", ";", ":", "::")
SIMPLE_DELIMITERS = ("|", "==", "\t", "::", ";")
FREQUENCY_WEIGHT, CONSISTENCY_WEIGHT = 0.4, 0.6
ACCEPT, READY, REVIEW, KNOWN_ID_BONUS = 0.70, 0.85, 0.5, 0.1


def _is_blank(line: Column) -> Column:
    return strip(line) == ""


def profile(lines: DataFrame) -> DataFrame:
    """(path, line_count, blank_lines, min_length, max_length, avg_length); lengths of non-blank lines."""
    size = F.when(~_is_blank(F.col("line")), F.length("line"))
    return lines.groupBy("path").agg(
        F.count("*").alias("line_count"), F.count_if(_is_blank(F.col("line"))).alias("blank_lines"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_length"), F.coalesce(F.max(size), F.lit(0)).alias("max_length"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_length"),
    )


def length_histogram(lines: DataFrame) -> DataFrame:
    rows = lines.filter(~_is_blank(F.col("line")))
    return rows.groupBy("path", F.length("line").alias("line_length")).agg(F.count("*").alias("lines"))


def occurrences(line: Column, delimiter: str) -> Column:
    """Non-overlapping occurrences, from the left."""
    gone = F.replace(line, F.lit(delimiter), F.lit(""))
    return ((F.length(line) - F.length(gone)) / len(delimiter)).cast("int")


def _counts(lines: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    return lines.select("path", "line_no", F.explode(F.array(*[
        F.struct(F.lit(d).alias("delimiter"), F.lit(i).alias("preference"), occurrences(F.col("line"), d).alias("cnt"))
        for i, d in enumerate(candidates)
    ])).alias("c")).select("path", "line_no", "c.*")


def delimiters(lines: DataFrame, candidates: tuple[str, ...] = DELIMITERS) -> DataFrame:
    """Per file and delimiter: frequency, mean and modal count, consistency and confidence.

    Of equally frequent counts the one seen first in the file is the mode.
    """
    hist = _counts(lines, candidates).groupBy("path", "delimiter", "preference", "cnt").agg(
        F.count("*").alias("n"), F.min("line_no").alias("seen"))
    positive = F.col("cnt") > 0
    by_file = hist.groupBy("path", "delimiter", "preference").agg(
        F.sum("n").alias("_all"), F.sum(F.when(positive, F.col("n"))).alias("_hits"),
        F.sum(F.when(positive, F.col("n") * F.col("cnt"))).alias("_total"),
        F.max_by(F.struct("cnt", "n"), F.when(positive, F.struct("n", -F.col("seen")))).alias("_mode"),
    )
    hits = F.coalesce("_hits", F.lit(0))
    frequency = hits / F.col("_all")
    consistency = F.when(hits > 0, F.col("_mode.n") / hits).otherwise(0.0)
    return by_file.select(
        "path", "delimiter", "preference", frequency.alias("frequency"),
        F.when(hits > 0, F.col("_total") / hits).otherwise(0.0).alias("avg_count"), consistency.alias("consistency"),
        F.when(hits > 0, F.col("_mode.cnt")).otherwise(0).alias("mode_count"),
        F.when(hits > 0, F.col("_mode.cnt") + 1).otherwise(0).alias("estimated_columns"),
        (frequency * FREQUENCY_WEIGHT + consistency * CONSISTENCY_WEIGHT).alias("confidence"),
    )


def simple_delimiters(lines: DataFrame) -> DataFrame:
    """Per file and delimiter: share of lines with it and mean count on those lines."""
    positive = F.col("cnt") > 0
    return _counts(lines, SIMPLE_DELIMITERS).groupBy("path", "delimiter").agg(
        (F.count_if(positive) / F.count("*")).alias("score"),
        F.coalesce(F.avg(F.when(positive, F.col("cnt"))), F.lit(0.0)).alias("avg_count"),
    )


def structure(lines: DataFrame) -> DataFrame:
    """(path, structure, confidence): fixed width when lengths differ by at most two, surer when more than
    five positions are blank on every line; else whitespace when most lines have wide gaps."""
    rows = lines.filter(~_is_blank(F.col("line")))
    shape = rows.groupBy("path").agg(
        F.min(F.length("line")).alias("lo"), F.max(F.length("line")).alias("hi"), F.count("*").alias("n"),
        F.count_if(F.col("line").rlike(r"\s{2,}")).alias("gapped"),
    )
    even = (F.col("lo") > 0) & (F.col("hi") - F.col("lo") <= 2)
    even_lines = rows.join(shape.filter(even).select("path", "lo"), "path").select("path", F.expr("left(line, lo)").alias("line"))
    inked = occupancy.inked_count(occupancy.occupancy(even_lines, "path"), "path")
    blank = F.col("lo") - F.coalesce("inked", F.lit(0))
    fixed = F.when((F.col("n") > 2) & (blank > 5), 0.95).otherwise(0.8)
    gapped = F.col("gapped") / F.col("n") > 0.5
    return shape.join(inked, "path", "left").select(
        "path", F.when(even, "FIXED_WIDTH").when(gapped, "WHITESPACE").otherwise("UNKNOWN").alias("structure"),
        F.when(even, fixed).when(gapped, 0.7).otherwise(0.0).alias("confidence"),
    )


def classify(delimiter_scores: DataFrame, structures: DataFrame, metadata: DataFrame) -> DataFrame:
    """Best candidate per file with its confidence, status and reason."""
    a = delimiter_scores.filter(F.col("confidence") >= ACCEPT).select(
        "path", F.lit("DELIMITED").alias("format"), "delimiter", "confidence", "preference",
        F.concat(F.lit("Delimiter '"), "delimiter", F.lit("' found consistently")).alias("reason"))
    b = structures.filter(F.col("confidence") >= ACCEPT).select(
        "path", F.col("structure").alias("format"), F.lit("").alias("delimiter"), "confidence",
        F.lit(len(DELIMITERS)).alias("preference"), F.concat(F.lit("Structure matched "), "structure").alias("reason"))
    best = a.unionByName(b).groupBy("path").agg(
        F.max_by(F.struct("format", "delimiter", "confidence", "reason"), F.struct("confidence", -F.col("preference"))).alias("best"))
    rows = metadata.join(best, "path", "left")
    found, known = F.col("best").isNotNull(), F.col("REPORT_ID") != ""
    confidence = F.when(
        found & known, F.least(F.lit(1.0), F.col("best.confidence") + KNOWN_ID_BONUS)
    ).otherwise(F.coalesce("best.confidence", F.lit(0.0)))
    reason = F.coalesce("best.reason", F.lit("No clear structure or delimiter detected"))
    return rows.select(
        "path", "REPORT_ID", "BRANCH_CODE", "BRANCH_NAME", "PROC_DATE",
        F.coalesce("best.format", F.lit("UNKNOWN")).alias("format"), F.coalesce("best.delimiter", F.lit("")).alias("delimiter"),
        confidence.alias("confidence"),
        F.when(confidence >= READY, "READY").when(confidence >= REVIEW, "REVIEW").otherwise("UNKNOWN").alias("status"),
        F.when(found & known, F.concat(reason, F.lit(", and REPORT_ID "), "REPORT_ID", F.lit(" detected")))
        .otherwise(reason).alias("reason"),
    )


def classification_report(inventory: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per file, ready for CSV."""
    return inventory.join(classes, "path", "left").select(
        file_name(F.col("path")).alias("file_name"), F.col("path").alias("file_path"), F.col("size_bytes").alias("file_size"),
        F.col("REPORT_ID").alias("report_id"), F.col("BRANCH_CODE").alias("branch_code"),
        F.col("BRANCH_NAME").alias("branch_name"), F.col("PROC_DATE").alias("process_date"),
        F.col("format").alias("detected_format"), F.format_number("confidence", 2).alias("confidence"),
        F.coalesce("status", F.lit("ERROR")).alias("status"), "reason",
    )


def file_outcomes(classes: DataFrame, routed: DataFrame, records: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Outcome of a run per file: read files become SUCCESS, ready files without a layout go to REVIEW.

    ``records``: (path, records, valid_records, invalid_records) of the parsed files.
    """
    ready = F.col("status") == "READY"
    rows = classes.join(routed.select("path", "layout"), "path", "left").join(records, "path", "left")
    status = (
        F.when(ready & F.col("layout").isNotNull(), "SUCCESS").when(ready, "REVIEW").otherwise(F.col("status"))
    )
    parsed = ready & F.col("layout").isNotNull()
    done = rows.select(
        "path", status.alias("status"), F.col("REPORT_ID").alias("report_type"), "format", "confidence",
        *[F.when(parsed, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
          for c in ("records", "valid_records", "invalid_records")],
        F.when(ready & F.col("layout").isNull(), F.concat(F.lit("No layout for report "), "REPORT_ID")).alias("error"),
    )
    if failed is None:
        return done
    return done.unionByName(failed.select("path", F.lit("ERROR").alias("status"), "error"), allowMissingColumns=True).fillna(
        {"confidence": 0.0, "records": 0, "valid_records": 0, "invalid_records": 0})


def batch_summary(outcomes: DataFrame) -> DataFrame:
    def files(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return outcomes.agg(
        F.count("*").alias("total_files"), files("SUCCESS").alias("successful"), files("REVIEW").alias("review"),
        files("UNKNOWN").alias("unknown"), F.count_if(~F.col("status").isin("SUCCESS", "REVIEW", "UNKNOWN")).alias("failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (
            ("records", "total_records"), ("valid_records", "valid_records"), ("invalid_records", "invalid_records"))],
    )
