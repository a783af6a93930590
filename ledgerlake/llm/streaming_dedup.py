"""Exact dedup as a stateful stream, in DataFrame functions alone.

Documents arrive as a stream of files. Its state is keyed by the digest of the normalised text, lies in RocksDB on the
executors' disks with its checkpoint in the shared folder, and never expires. For each digest it retains the stable
identifier of the row that stays (the greatest key), that row's content locator (file and row in the file) and
the number of rows met. A call with the same ``state`` folder takes in only files that have arrived since.

A digest met more than once is a hit. Rows of hits, and no others, are checked by their full bytes: their texts are grouped by
(digest, text), combined before the shuffle, so that any number of copies sends one text a task. A digest that turns out
to stand for several texts is split into one group for each. Texts meet the hits in a sort-merge join at every size; a hot
digest is split there by AQE, since the result is written before it is grouped.

Defined cases: a null text is empty, and empty texts equal one another; a null key is the least one and stays only where
all keys of its group are null; repeated rows are rows of their own, and of equal greatest keys exactly one row stays; very long texts are
digested and compared whole; an empty folder gives an empty result; other columns are never read, so their names cannot clash."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored

#: Files that one micro-batch takes in.
FILES_PER_BATCH = 10_000
#: State on disk; files of a store are not allocated ahead, since there is one store for each shuffle partition.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: The state's values in the order of ``_gathered``; an aggregate by maximum holds its value and what it is ordered by.
VALUES = "struct<keep:bigint,file:bigint,by_file:bigint,row:bigint,by_row:bigint,n:bigint>"

Digest = Callable[[Column], Column]


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, key: str, text: str, digest: Digest) -> DataFrame:
    """``(key, digest, file, row, text)``, the locator being the hash of the file's path and the row's place in it."""
    place, words = docs.metadataColumn("_metadata"), normal(F.col(text))
    return docs.select(
        F.col(key).cast("bigint").alias("key"), digest(words).alias("digest"), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"), words.alias("text")
    )


def _gathered(rows: DataFrame, *by: str) -> DataFrame:
    """One row a group: the greatest key, its locator and the number of rows. All buffers are longs, so hashing does it."""
    order = F.coalesce("key", F.lit(-(1 << 63)))
    return rows.groupBy(*by).agg(F.max("key").alias("keep"), F.max_by("file", order).alias("file"), F.max_by("row", order).alias("row"), F.count(F.lit(1)).alias("n"))


def _glob(path: str) -> str:
    """The path as a pattern that only it matches: a stream takes a single file only by a pattern."""
    head, last = path.rstrip("/")[:-1], path.rstrip("/")[-1]
    return f"{head}[{last}]"


def state_of(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", state: str | None = None, digest: Digest = sha) -> DataFrame:
    """``(digest, keep, file, row, n)``: the state after all files of ``path`` that it has not met yet are taken in."""
    folder = state or f"{shared_folder(spark)}/ledgerlake/dedup-state-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(_glob(path))
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, setting in STATE_SETTINGS.items():
        spark.conf.set(name, setting)
    try:
        met = _gathered(_rows(arriving, key, text, digest).drop("text"), "digest")
        query = met.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
        query.awaitTermination()
        held = spark.read.format("statestore").load(folder)
        value = F.col("value").cast(VALUES)
        return stored(held.select(F.col("key")["digest"].alias("digest"), *(value[c].alias(c) for c in ("keep", "file", "row", "n"))), "dedup-held")
    finally:
        for name, setting in before.items():
            if setting is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, setting)


def groups(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", state: str | None = None, digest: Digest = sha) -> DataFrame:
    """``(key, digest, file, row, keep_id, group_size, kept)`` for every row of the Parquet files in ``path``."""
    held = state_of(spark, path, key, text, state, digest)
    rows = _rows(spark.read.parquet(path), key, text, digest)
    # Hits: their texts, written once, then compared byte by byte through the grouping key.
    hits = held.filter("n > 1").select("digest").hint("merge")
    checked = stored(rows.join(hits, "digest", "left_semi"), "dedup-hits")
    texts = stored(_gathered(checked, "digest", "text"), "dedup-texts")
    split = stored(texts.groupBy("digest").count().filter("count > 1").select("digest"), "dedup-split")

    def judged(rows: DataFrame, found: DataFrame, *by: str) -> DataFrame:
        found = found.withColumnsRenamed({"file": "keep_file", "row": "keep_row"})
        kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        return rows.join(found, list(by)).select("key", "digest", "file", "row", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"))

    plain = judged(rows.drop("text"), held.join(split, "digest", "left_anti"), "digest")
    return plain.unionByName(judged(checked.join(split, "digest", "left_semi"), texts, "digest", "text"))


def survivors(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", state: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    docs = spark.read.parquet(path)
    place = docs.metadataColumn("_metadata")
    stay = groups(spark, path, key, text, state).filter("kept").select(F.col("file").alias("_dedup_file"), F.col("row").alias("_dedup_row"))
    here = (F.xxhash64(place["file_path"]) == F.col("_dedup_file")) & (place["row_index"] == F.col("_dedup_row"))
    return docs.join(stay, here, "left_semi")


def groups_sql() -> str:
    return f"""
    with d as (select doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as t from documents)
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
    from d window w as (partition by t)
    """
