"""Files arriving in a folder, ingested in stateless micro-batches.

Replays are safe: a batch replaces whole (date, branch) pairs, and damaged files go to a
quarantine table instead of stopping the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files, ingest

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Names of the files that arrive; their contents are not read here."""
    return (
        spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{txt,txt.gz}").option("maxFilesPerTrigger", per_batch).load(folder)
        .select("path").filter(files.report_path(F.col("path"), folder))
    )


def _batch(root: str, work: str, limit: int):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, area = batch.sparkSession, f"{work}/batch={batch_id}"
        names = [r.path for r in batch.collect()]  # at most ``per_batch``
        if not names:
            return
        lines, failed = files.read_listed(spark, names, area, limit)
        done = ingest.ingest_lines(spark, lines, root, area)
        skipped = done.filter("layout IS NULL").select("path", F.lit("no layout").alias("error"))
        failed.unionByName(skipped).write.mode("overwrite").parquet(f"{root}/_quarantine/batch={batch_id}")

    return run


def ingest_arrivals(spark: SparkSession, folder: str, root: str, work: str, per_batch: int = 1000, limit: int = files.BINARY_LIMIT) -> StreamingQuery:
    """Ingest what is there now and stop; run again for later files. ``work`` is a shared folder. Plain text of any size is read in
    splits; damaged ``.gz`` files, and those over ``limit`` bytes, go to the quarantine table."""
    return (
        arriving_files(spark, folder, per_batch).writeStream.foreachBatch(_batch(root, work, limit))
        .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    )
