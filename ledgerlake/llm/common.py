"""What several of these operators need: stored steps, text as byte arrays, word hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is named, a session on one machine gets a temporary one;
    on a cluster the executors would not see it, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ledgerlake-"))


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver next collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.
    The shuffle files of this write are not needed any more once the rows are stored, and go then."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerlake/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each (one row at least), so that memory does not follow the batch."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        below = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, below + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets - offsets[0], np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]


def spans(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray = ~WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and end byte of each word, a run of bytes that ``inside`` marks."""
    solid, edge = inside[data], np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return np.searchsorted(offsets, begin, "right") - 1, begin, end


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PLACE = np.uint64(0xD1B54A32D192ED03)
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: each piece of eight bytes is mixed by itself and again with its place, and the sum of
    the pieces is mixed with the length. Pieces meet only after mixing, so spans of few or regular bytes do not collide."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    at = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    salt = np.uint64(pow(int(_BASE), seed + 1, 1 << 64))
    length = end - begin

    def piece(from_: np.ndarray, left: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        return mixed(mixed((at[from_] & _TAIL[np.clip(left, 0, 8)]) ^ salt) + np.asarray(place, dtype=np.uint64) * _PLACE)

    with np.errstate(over="ignore"):
        total = piece(begin, length, 0)
        long = np.flatnonzero(length > 8)
        if len(long):
            more = (length[long] - 1) >> 3
            first = np.cumsum(more) - more
            place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
            from_ = np.repeat(begin[long], more) + 8 * place
            total[long] += np.add.reduceat(piece(from_, np.repeat(end[long], more) - from_, place), first)
        return mixed(total + length.astype(np.uint64) * salt)


def shingles(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``width`` words; a text with fewer words is one shingle, one without words none."""
    text, begin, end = spans(offsets, data)
    return grams(text, hashes(data, begin, end), width)


def grams(text: np.ndarray, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` items inside each text, in order; of a shorter text, the hash of all its items."""
    with np.errstate(over="ignore"):
        step = [np.uint64(pow(int(_BASE), k + 1, 1 << 64)) for k in range(width)]
        n, first = np.unique(text, return_counts=True)[1], np.flatnonzero(np.diff(text, prepend=-1))
        full = np.zeros(0, dtype=np.int64)
        mixed_full = np.zeros(0, dtype=np.uint64)
        if len(word) >= width:
            full = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1 :])
            total = np.zeros(len(full), dtype=np.uint64)
            for k in range(width):
                total += word[full + k] * step[k]
            mixed_full = mixed(total + np.uint64(width))
        short = first[n < width]
        total = np.zeros(len(short), dtype=np.uint64)
        size = n[n < width]
        for k in range(width - 1):
            has = size > k
            total[has] += word[short[has] + k] * step[k]
        shorter = mixed(total + size.astype(np.uint64))
    owner, value = np.concatenate([text[full], text[short]]), np.concatenate([mixed_full, shorter])
    order = np.argsort(owner, kind="stable")
    return owner[order], value[order]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links (a bigint, b bigint)`` as ``(node, component)``, component being its smallest node.

    In each round every node joins its first neighbour in an order drawn anew (a salted hash, which is one to one on bigint);
    the trees so made are brought to their roots by jumps and become the nodes of the next round. Each tree has two nodes at
    least, so a round leaves at most half of the nodes, whatever the ids and the shape of the links; rounds go on until no link
    is left. Links and labels are stored each round and stay distributed. Hot nodes are met by aggregates that are combined
    before the shuffle and by joins that can be split. Nodes without a link are not returned."""
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    ends = lambda some: some.select("a", "b").unionAll(some.select(F.col("b").alias("a"), F.col("a").alias("b")))
    some = stored(links.filter("a <> b").select(*ordered("a", "b")).distinct(), "links")
    label = stored(ends(some).select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    salt = 0
    while some.limit(1).count():
        drawn = lambda c, salt=salt: F.xxhash64(c, F.lit(salt))
        near = stored(ends(some).groupBy(F.col("a").alias("node")).agg(F.min_by("b", drawn("b")).alias("root")), "near")
        # Choices can only go round between two nodes that choose each other: the first of them is the root.
        up = near.select(F.col("node").alias("root"), F.col("root").alias("up"))
        first = F.when(drawn("node") < drawn("root"), F.col("node")).otherwise(F.col("root"))
        root = stored(near.join(up, "root").select("node", F.when(F.col("up") == F.col("node"), first).otherwise(F.col("up")).alias("root")), "roots")
        while True:
            up = root.select(F.col("node").alias("root"), F.col("root").alias("up"))
            new = stored(root.join(up, "root").select("node", F.col("up").alias("root"), F.col("root").alias("old")), "roots")
            root, moved = new.select("node", "root"), new.filter("root <> old").limit(1).count()
            if not moved:
                break
        up = root.select(F.col("node").alias("component"), F.col("root").alias("up"))
        label = stored(label.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        a, b = root.select(F.col("node").alias("a"), F.col("root").alias("x")), root.select(F.col("node").alias("b"), F.col("root").alias("y"))
        some = stored(some.join(a, "a").join(b, "b").filter("x <> y").select(*ordered("x", "y")).distinct(), "links")
        salt += 1
    least = label.groupBy("component").agg(F.min("node").alias("least"))
    return stored(label.join(least, "component").select("node", F.col("least").alias("component")), "labels")
