"""Report files to numbered lines.

Plain text is read by Spark's splittable text source, so one huge file is shared by many
tasks; lines get dense numbers from the split's offset. ``.gz`` files (not splittable, and
sometimes mislabelled plain text) are decompressed block by block inside the tasks, each once: the lines
are stored as they come, and a file that turns out to be damaged ends with a row that says so, whereupon
none of its lines counts. A ``.gz`` file over the 2 GB limit of the binary source is not opened; it
is reported like a damaged one.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GZIP_MAGIC = b"\x1f\x8b"
CHUNK = 20_000
#: Bytes of a file that the binary source can hold.
BINARY_LIMIT = 2**31 - 1
# Fixed value: the control report left out of every run.
EXCLUDED_NAME = "gend1012.prt2"
DECODED = "path string, line_no bigint, line string, error string"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def report_path(path: Column, folder: str) -> Column:
    """True for reports directly in the folder or in one of its all-digit subfolders."""
    base = re.sub(r"^[a-z0-9]+:/+", "/", folder).rstrip("/") + "/"
    below = F.substring_index(path, base, -1)
    return (
        path.contains(base)
        & below.rlike(r"^([0-9]+/)?[^/]+\.txt(\.gz)?$")
        & ~F.lower(file_name(path)).contains(EXCLUDED_NAME)
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Every .txt and .gz file below the folder with its size; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"))
    )
    return inventory_of(files)


def inventory_of(files: DataFrame) -> DataFrame:
    name = file_name(F.col("path"))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.withColumns({"file_name": name, "extension": suffix}).filter(suffix.isin(".gz", ".txt"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory limited to the files of a nightly run."""
    return inventory(spark, folder).filter(report_path(F.col("path"), folder))


def _text_lines(content: bytes) -> Iterator[str]:
    raw = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=raw) if content[:2] == GZIP_MAGIC else raw
    for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace"):
        yield line.rstrip("\r\n")


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of the batch's files in frames of bounded size; small files share a frame."""
    columns, rows = ["path", "line_no", "line", "error"], []
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            number = 0
            try:
                for number, line in enumerate(_text_lines(content), 1):
                    rows.append((path, number - 1, line, None))
                    if len(rows) == CHUNK:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except (OSError, EOFError, zlib.error) as e:
                rows.append((path, number, None, f"{type(e).__name__}: {e}"))
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def decode_files(files: DataFrame, limit: int = BINARY_LIMIT) -> DataFrame:
    """(path, content) to (path, line_no, line, error), decompressing once: a damaged file gives the lines above the damage
    and then one error row (see ``whole_files``), one over ``limit`` bytes only an error row."""
    return files.select("path", F.when(F.length("content") <= limit, F.col("content")).alias("content"), F.length("content").alias("size")).transform(
        lambda f: f.filter("content IS NOT NULL").select("path", "content").mapInPandas(_decode, DECODED).unionByName(_too_large(f.filter("content IS NULL"), "size")))


def _too_large(files: DataFrame, size: str) -> DataFrame:
    error = F.concat(F.lit("TooLarge: "), F.col(size).cast("string"), F.lit(" bytes"))
    return files.select("path", F.lit(0).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("line"), error.alias("error"))


def whole_files(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of undamaged files, (path, error) of the others) of stored decoded rows."""
    failed = decoded.filter("error IS NOT NULL").select("path", "error")
    return decoded.filter("error IS NULL").drop("error").join(failed.select("path"), "path", "left_anti"), failed


def _numbered(found: DataFrame) -> DataFrame:
    """Row ids are consecutive within a split, so a line's number follows from its split's first id: lines are neither sorted
    nor ranked, they only meet a table of one row a split."""
    raw = found.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.make_valid_utf8("value").alias("line"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    sizes = raw.groupBy("path", "_split").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.join(starts, ["path", "_split"]).select("path", (F.col("_seq") + F.col("_shift")).alias("line_no"), "line")


def text_lines(spark: SparkSession, folder: str, glob: str = "*.txt", reports_only: bool = False) -> DataFrame:
    """Numbered lines of the plain text files; ``reports_only``: those of a nightly run (``report_path``). The path filter lies below the
    numbering, where Spark can apply it to the list of files."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    return _numbered(found.filter(report_path(F.col("_metadata.file_path"), folder)) if reports_only else found)


def _decoded(found: DataFrame, work: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Lines and failures of binary files (path, length, content), decoded into ``work`` once."""
    spark = found.sparkSession
    # The source does not open files that the filter on their length leaves out.
    rows = decode_files(found.filter(F.col("length") <= limit), limit).unionByName(_too_large(found.filter(F.col("length") > limit), "length"))
    rows.write.mode("overwrite").parquet(f"{work}/decoded")
    return whole_files(spark.read.schema(DECODED).parquet(f"{work}/decoded"))


def _binary(spark: SparkSession):
    return spark.read.format("binaryFile")


def read_reports(spark: SparkSession, folder: str, work: str, limit: int = BINARY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(lines, failed files) of a nightly folder."""
    zipped = _binary(spark).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt.gz").load(folder)
    zipped = zipped.select(F.col("_metadata.file_path").alias("path"), "length", "content").filter(report_path(F.col("path"), folder))
    lines, failed = _decoded(zipped, work, limit)
    return text_lines(spark, folder, reports_only=True).unionByName(lines), failed


def read_listed(spark: SparkSession, paths: list[str], work: str, limit: int = BINARY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(lines, failed files) of the files listed, plain and zipped."""
    plain, zipped = [p for p in paths if not p.endswith(".gz")], [p for p in paths if p.endswith(".gz")]
    nothing = spark.createDataFrame([], DECODED)
    lines, failed = nothing.drop("error"), nothing.select("path", "error")
    if zipped:
        lines, failed = _decoded(_binary(spark).load(zipped).select(F.col("_metadata.file_path").alias("path"), "length", "content"), work, limit)
    return (lines.unionByName(_numbered(spark.read.text(plain))) if plain else lines), failed
