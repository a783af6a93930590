"""Hard-negative mining by secondary sort.

Scores are packed into keys of 25 bytes whose order as bytes is (anchor, descending score, kind, id), positives before
negatives. ``repartitionAndSortWithinPartitions`` sends the keys of one anchor to one partition in that order, and an iterator
walks them once: a positive opens its window of scores, each negative goes to the open windows that it fits, and
a full window takes no more. It holds the open windows of one anchor and nothing else.

Two such walks are made. The first finds the positives of each anchor. The second knows their scores, so that a task
sends for each anchor and window only its own best negatives: what is shuffled grows with anchors and tasks, not with
pairs, and no anchor's candidates come together in one place. Anchors meet the rows in blocks: rows lie in
packs dealt to shares of about ``SHARE_ROWS`` rows, every block of anchors is sent to each share.

Components are integers (``floor(scale * x)``, cut to 64 bits), scores exact integers, beyond 64 bits cut to the nearest one.

Defined cases: rows with a null key, label or vector, or a null or non-finite component, take no part; rows of
different lengths have no inner product and never meet; rows equal in key, label and vector count once; rows that share only the key are
rows of their own, as an anchor the first by (label, vector) counts; a positive of negative score has an empty
window; equal scores go by ascending key; an empty table gives an empty result; other columns are never read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Rows of a share that all anchors are sent to, least number of shares, most rows in a pack, most candidates that a task holds.
SHARE_ROWS, SHARES, PACK, MOST_HELD = 1 << 18, 8, 1024, 400_000

_KEY, _HALF = struct.Struct(">QQBQ"), 1 << 63
_FIELDS = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_LEAST = np.iinfo(np.int64).min


def packed_key(anchor: int, score: int, kind: int, row: int) -> bytes:
    return _KEY.pack(anchor + _HALF, _HALF - 1 - score, kind, row + _HALF)


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = _KEY.unpack(key)
    return anchor - _HALF, _HALF - 1 - score, kind, row - _HALF


def _keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    out = np.empty(len(anchor), dtype=_FIELDS)
    flip = np.uint64(_HALF)
    out["anchor"], out["score"], out["kind"], out["id"] = anchor.view(np.uint64) ^ flip, (~score).view(np.uint64) ^ flip, kind, ids.view(np.uint64) ^ flip
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_FIELDS.itemsize), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def participants(vectors: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, label, vec)`` of the rows that take part, components as integers."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.when(finite, whole).alias("vec"))
    return rows.dropna().dropDuplicates(["id", "label", "vec"])


def _packs(rows: DataFrame) -> DataFrame:
    """``(size, ids, labels, vecs, tops)``: up to ``PACK`` rows of one vector length in ascending order of their ids. ``tops``
    holds the scores of each row's positives where the rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            ids = batch.column(0).to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                at = at[np.argsort(ids[at], kind="stable")]
                for a in range(0, len(at), PACK):
                    some = batch.take(pa.array(at[a : a + PACK]))
                    rest = [some.column(c).to_numpy().astype(np.int64).tobytes() for c in (0, 1)] + [some.column(2).flatten().to_numpy().tobytes()]
                    tops = np.full((some.num_rows, POSITIVES), _LEAST, dtype=np.int64)
                    if some.num_columns > 3:
                        for k, top in enumerate(some.column(3).to_pylist()):
                            tops[k, : len(top)] = top
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32())] + [pa.array([x], pa.binary()) for x in (*rest, tops.tobytes())], ["size", "ids", "labels", "vecs", "tops"])

    return rows.mapInArrow(run, "size int, ids binary, labels binary, vecs binary, tops binary")


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b; those beyond 64 bits are cut to the nearest integer there."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if bound < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), _LEAST, -_LEAST - 1).astype(np.int64)


def windows(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score with 30 * top <= 100 * score <= 90 * top; for no top an empty range."""
    tens, ones = np.divmod(tops, 10)
    low, high = 3 * tens - (-3 * ones) // 10, 9 * tens + 9 * ones // 10
    none = tops < 0
    return np.where(none, 1, low), np.where(none, 0, high)


def _first(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row among those that fit; of equal ones the first columns."""
    if score.shape[1] > k:
        held = np.where(fits, score, _LEAST)
        fits = fits & (score >= np.partition(held, -k, axis=1)[:, -k][:, None])
    a, b = np.nonzero(fits)
    order = np.lexsort((b, ~score[a, b], a))
    a, b = a[order], b[order]
    keep = _rank(a) < k
    return a[keep], b[keep]


def _rank(group: np.ndarray) -> np.ndarray:
    """Place of each item in its run of equal values."""
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if len(group) else np.zeros(0, dtype=np.int64)
    return np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))


class _Held:
    """The k best candidates of each (anchor, window) that a task has met."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, anchor: np.ndarray, window: int, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((anchor, np.full(len(anchor), window, dtype=np.int64), score, ids))
        self.n += len(anchor)

    def best(self) -> tuple[np.ndarray, ...]:
        anchor, window, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, dtype=np.int64),) * 4
        order = np.lexsort((ids, ~score, window, anchor))
        anchor, window, score, ids = anchor[order], window[order], score[order], ids[order]
        group = np.cumsum((np.diff(anchor, prepend=0) != 0) | (np.diff(window, prepend=0) != 0))
        keep = _rank(group) < self.k
        self.parts = [(anchor[keep], window[keep], score[keep], ids[keep])]
        self.n = int(keep.sum())
        return self.parts[0]


def _candidates(met: DataFrame, negative: bool) -> DataFrame:
    """Keys of the candidates that can count, of all pairs of an anchor block with a pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(NEGATIVES if negative else POSITIVES)

        def flush() -> pa.RecordBatch:
            anchor, _, score, ids = held.best()
            return pa.RecordBatch.from_arrays([_keys(anchor, score, int(negative), ids)], ["key"])

        def numbers(value: pa.Scalar) -> np.ndarray:
            return np.frombuffer(value.as_buffer(), dtype=np.int64)

        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                size = values[0].as_py()
                ids, labels, vecs, a_ids, a_labels, a_vecs, tops = map(numbers, values[1:])
                score = inner_products(a_vecs.reshape(len(a_ids), size), vecs.reshape(len(ids), size))
                same = a_labels[:, None] == labels[None, :]
                if negative:
                    low, high = windows(tops.reshape(len(a_ids), POSITIVES))
                    for w in range(POSITIVES):
                        a, b = _first(score, ~same & (score >= low[:, w, None]) & (score <= high[:, w, None]), NEGATIVES)
                        held.add(a_ids[a], w, score[a, b], ids[b])
                else:
                    a, b = _first(score, same & (a_ids[:, None] != ids[None, :]), POSITIVES)
                    held.add(a_ids[a], 0, score[a, b], ids[b])
                if held.n > MOST_HELD:
                    held.best()
                    if held.n > MOST_HELD // 2:
                        yield flush()
                        held = _Held(held.k)
        yield flush()

    return met.mapInArrow(run, "key binary")


def _first_positives(rows) -> Iterator[tuple[int, int, int]]:
    """(anchor, positive, score) of the first positives of each anchor in a sorted partition."""
    anchor, taken, last = None, 0, None
    for key, _ in rows:
        if key == last:
            continue
        last = key
        owner, score, _, row = unpacked(key)
        if owner != anchor:
            anchor, taken = owner, 0
        if taken < POSITIVES:
            taken += 1
            yield owner, row, score


def _walk(rows) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from a sorted partition."""
    anchor, opened, last = None, [], None
    for key, _ in rows:
        if key == last:  # a negative that several windows sent
            continue
        last = key
        owner, score, negative, row = unpacked(key)
        if owner != anchor:
            anchor, opened = owner, []
        if not negative:
            opened.append([row, score, 0])
            continue
        for window in opened:
            positive, top, taken = window
            if taken < NEGATIVES and 30 * top <= 100 * score <= 90 * top:
                window[2] += 1
                yield owner, positive, taken + 1, row, top, score


def _secondary_sort(keys, walk, partitions: int):
    return keys.repartitionAndSortWithinPartitions(partitions, _by_anchor).mapPartitions(walk)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: of each row that ``is_anchor`` (a condition
    on ``id``) takes, the first negatives of each of its first positives."""
    spark = vectors.sparkSession
    data = stored(participants(vectors, F.col("label") if label is None else label, key, vector, scale), "mining-rows")
    packed = stored(_packs(data), "mining-packs")
    shares = max(SHARES, -(-data.count() // SHARE_ROWS))
    shared = packed.select("size", F.pmod(F.xxhash64("ids"), F.lit(shares)).alias("share"), "ids", "labels", "vecs")
    first = data.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row"))
    anchors = stored(first.select("id", "row.label", "row.vec"), "mining-anchors")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def met(some: DataFrame) -> DataFrame:
        blocks = _packs(some).select("size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))).alias("share"), *(F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vecs", "tops")))
        return shared.join(blocks, ["size", "share"]).select("size", "ids", "labels", "vecs", "a_ids", "a_labels", "a_vecs", "a_tops")

    def keys(some: DataFrame, negative: bool):
        return _candidates(met(some), negative).rdd.map(lambda row: (bytes(row[0]), None))

    found = spark.createDataFrame(_secondary_sort(keys(anchors, False), _first_positives, partitions), "id bigint, positive bigint, score bigint", verifySchema=False)
    found = stored(found, "mining-positives")
    topped = stored(anchors.join(found.groupBy("id").agg(F.collect_list("score").alias("tops")), "id"), "mining-topped")
    opening = found.rdd.map(lambda row: (packed_key(row[0], row[2], 0, row[1]), None))
    mined = _secondary_sort(keys(topped, True).union(opening), _walk, partitions)
    return spark.createDataFrame(mined, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint", verifySchema=False)


def mine_sql(every: int = 100) -> str:
    return f"""
    with e as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double)::bigint for x in embedding] as v
      from embeddings
      where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    ),
    p as (
      select a.vec_id as anchor_id, r.vec_id as row_id, a.label = r.label as same,
             list_sum([z[1] * z[2] for z in list_zip(a.v, r.v)])::bigint as score
      from e a join e r on a.vec_id <> r.vec_id where a.vec_id % {every} = 0
    ),
    t as (select * from p where same qualify row_number() over (partition by anchor_id order by score desc, row_id) <= {POSITIVES})
    select t.anchor_id, t.row_id as positive_id, (row_number() over w)::int as rank, p.row_id as negative_id, t.score as positive_score, p.score as negative_score
    from t join p on p.anchor_id = t.anchor_id and not p.same and 30 * t.score <= 100 * p.score and 100 * p.score <= 90 * t.score
    window w as (partition by t.anchor_id, t.row_id order by p.score desc, p.row_id)
    qualify row_number() over w <= {NEGATIVES}
    """
