"""Packing along a space-filling curve: documents that share words are put next to each other in the training sequences.

Each document's hashed bag of words is projected to a few dimensions (a random sign for each word and dimension), the
projection is quantised and turned into a Hilbert key. Documents are range-partitioned by that key, the token counts before
each are summed inside partitions and then over partitions, and the stream of all tokens is cut at every ``length`` tokens.
What is left at the end is cut into powers of two, which need no padding.

Tokens are written once to the shared folder and shuffled once, to meet their places; the range partitioning moves only
keys and counts. The driver sees one number for each partition.

Defined cases: a null or empty text has the closing id alone; equal keys (copies) are ordered by the row's number, so that
a large group of copies is spread over partitions; repeated rows are packed each; an empty table gives no pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import hashes, mixed, slices, spans, stored, utf8

DIMENSIONS, BITS = 4, 8
LENGTH, CLOSING = 4096, 2


def projections(text: np.ndarray, word: np.ndarray, rows: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Mean random sign of each text's words in each dimension, (rows, dimensions), between -1 and 1."""
    sign, count = mixed(word), np.maximum(np.bincount(text, minlength=rows), 1)
    return np.stack([np.bincount(text, weights=((sign >> np.uint64(k)) & np.uint64(1)).astype(np.int8) * 2.0 - 1, minlength=rows) / count for k in range(dimensions)], 1)


def quantised(vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whole coordinates of ``bits`` bits, finest around zero, where most projections are."""
    unit = np.arctan(4 * vectors) / (2 * np.arctan(4.0)) + 0.5
    return np.clip(unit * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of points with ``bits``-bit coordinates, by exchanging and inverting low bits from
    the top bit down, then taking the Gray code and interleaving."""
    x = points.T.copy()
    n, bit = len(x), 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(n):
            high = (x[k] & bit) > 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
        bit >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            key = key << 1 | (x[k] >> b) & 1
    return key


def tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", closing: int = CLOSING) -> DataFrame:
    """``(doc, row, curve, n, ids)``: ids as bytes, two for each id where the vocabulary allows it."""
    source = docs.sparkSession.sparkContext.broadcast(bpe.read_tokenizer(path))
    kind = next(f for f in docs.schema.fields if f.name == key).dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.encoder(source.value)
        width = np.uint16 if len(model.token) <= 1 << 16 else np.uint32
        for whole in batches:
            for batch in slices(whole, 1, bpe.BATCH_BYTES):
                ids, counts = model.encode(batch, 1)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, closing).astype(width)
                counts = counts + 1
                curve = []
                for part in slices(batch, 1):
                    offsets, data = utf8(part.column(1))
                    owner, begin, end = spans(offsets, data)
                    curve.append(hilbert_keys(quantised(projections(owner, hashes(data, begin, end), part.num_rows))))
                at = np.concatenate([[0], np.cumsum(counts) * ids.itemsize]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(curve)), pa.array(counts), packed], ["doc", "curve", "n", "ids"])

    made = docs.select(F.col(key).alias("doc"), text).mapInArrow(run, f"doc {kind}, curve bigint, n bigint, ids binary")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "tokens")


def places(made: DataFrame) -> DataFrame:
    """``(row, part, before)``: the range partition along the curve and the tokens before the document inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), pa.array(starts), batch.column("n")], ["row", "part", "before", "n"])

    narrow = made.select("curve", "row", "n").repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    narrow = narrow.select("row", F.spark_partition_id().alias("part"), "n")
    return stored(narrow.mapInArrow(run, "row bigint, part int, before bigint, n bigint"), "places")


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """One row for each piece of a document: the key, ``start`` (ids of the document before it), ``length``, ``ids``
    (little-endian 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in that sequence."""
    made = tokens(docs, path, key, text, closing)
    placed = places(made)
    sums = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, total = {}, 0
    for part, n in sums:
        base[part], total = total, total + n
    full = total // length
    rest = [1 << b for b in range(total.bit_length(), -1, -1) if (total % length) >> b & 1]
    tail = np.cumsum([full * length, *rest])
    kind = made.schema["doc"].dataType.simpleString()

    def cut(start: int, end: int) -> list[tuple[int, int, int, int]]:
        """(first, end, sequence, offset) of the pieces of a stretch of the stream."""
        out = []
        while start < end:
            if start < full * length:
                sequence, offset = divmod(start, length)
                stop = start - offset + length
            else:
                k = int(np.searchsorted(tail, start, "right"))
                sequence, offset, stop = full + k - 1, start - int(tail[k - 1]), int(tail[k])
            stop = min(stop, end)
            out.append((start, stop, sequence, offset))
            start = stop
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("ids")):
                rows, owner = [], []
                columns = [batch.column(c).to_pylist() for c in ("part", "before", "n", "ids")]
                for k, (part, before, n, ids) in enumerate(zip(*columns, strict=True)):
                    ids = np.frombuffer(ids, dtype=np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4")
                    begin = base[part] + before
                    for a, b, sequence, offset in cut(begin, begin + n):
                        owner.append(k)
                        rows.append((a - begin, b - a, ids[a - begin : b - begin].tobytes(), n, sequence, offset))
                found = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(owner, pa.int64())), *[pa.array(list(v), t) for v, t in zip(found, types[1:], strict=True)]], names)

    schema = f"doc {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    joined = made.select("row", "doc", "ids").join(placed, "row").select("doc", "part", "before", "n", "ids")
    return joined.mapInArrow(run, schema).withColumnRenamed("doc", key)
