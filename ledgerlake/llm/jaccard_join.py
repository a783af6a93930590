"""N-gram Jaccard join with adaptive multi-match prefixes, as classes of near-duplicates.

A document's set holds its distinct five-word shingles; two documents link when the sets' Jaccard similarity is 0.75 or more.
All shingles are put in one order, those of crowded hash buckets last. If two sets of n and m shingles reach the
threshold, then for every l their prefixes of n - ceil(0.75 n) + l and m - ceil(0.75 m) + l shingles share l at least. Each
document picks its own l: the one with the least estimated cost of its prefix and of the candidates that it would bring,
l shared shingles being asked of each. A pair is a candidate when its prefixes share the smaller of the two l.

The work that does not grow with the square of a group: equal sets become one node before anything is joined; a shingle's
documents are first compared with a few of them, hubs in random order; links found so join documents into components;
and full candidates are then sought only between different components, over shingles that more than one component has.
Every link is confirmed on the whole sets. The bucket counts have a fixed size, whatever the input.

Sets and nodes are compared by 64-bit hashes. Defined cases: null and empty texts have an empty set and are linked with
nothing; a text of fewer than five words is one shingle; repeated rows are copies; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, components, mixed, shingles, signed, slices, stored, utf8

WIDTH, SHARE = 5, 75  # words of a shingle; least similarity in hundredths
BUCKETS = 1 << 18
#: What a candidate costs beside one shingle of a prefix: its whole set has to be met, and that much at least.
LEAST_COST = 40
#: The least l is this part of a set: so much longer a prefix costs little and asks for as many shared shingles.
LEAST_PART = 8
#: Hubs that a node is compared with in each round, and rounds, before the full search between components.
HUBS, ROUNDS = 4, 2
#: Shingles before a shingle that tell whether a pair met already.
LOOK_BACK = 4
UNIT_BYTES = 8 << 20
#: Text whose words are hashed at once: the arrays of that much stay in a core's cache.
HASHED_BYTES = 1 << 18
MOST_SEEN = 500_000
#: Rows of prefixes that are packed together, and shingles in a range of them.
PACK_ROWS, RANGE_ROWS = 1 << 18, 1 << 20


def sets(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, those of each text in order, and where each text's begin, with the end of all."""
    values, sizes = [], []
    for part in slices(batch, column, HASHED_BYTES):
        offsets, data = utf8(part.column(column))
        owner, value = shingles(offsets, LOWER[data], WIDTH)
        cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            value[a:b].sort()
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        values.append(value[new])
        sizes.append(np.bincount(owner[new], minlength=part.num_rows))
    starts = np.zeros(batch.num_rows + 1, dtype=np.int64)
    if sizes:
        starts[1:] = np.cumsum(np.concatenate(sizes))
    return np.concatenate(values) if values else np.zeros(0, dtype=np.uint64), starts


def names(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two independent hashes of each set, a row of two."""
    sizes = np.diff(starts)
    some, both = sizes > 0, np.zeros((len(sizes), 2), dtype=np.uint64)
    with np.errstate(over="ignore"):
        if some.any():
            for k, h in enumerate((values + np.uint64(1), values ^ np.uint64(0x5851F42D4C957F2D))):
                both[some, k] = np.add.reduceat(mixed(h), starts[:-1][some])
        both[:, 0] += sizes.astype(np.uint64)
        return signed(mixed(both))


def bucket(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(46)).astype(np.int64)


def least_shared(n: int) -> int:
    return -(-SHARE * n // 100)


def described(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """``(doc, n, node, other)`` of each row, stored, and the shingle counts of all buckets."""
    kind = next(f for f in docs.schema.fields if f.name == key).dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names_of = np.zeros(BUCKETS, dtype=np.int64), ["doc", "n", "node", "other", "counts"]
        doc_type = None
        for whole in batches:
            doc_type = whole.schema.field(0).type
            for batch in slices(whole, 1, UNIT_BYTES):
                values, starts = sets(batch, 1)
                counts += np.bincount(bucket(values), minlength=BUCKETS)
                named = names(values, starts)
                nothing = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(named[:, 0]), pa.array(named[:, 1]), nothing], names_of)
        if doc_type is not None:
            blank = [pa.nulls(1, t) for t in (doc_type, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([counts], pa.list_(pa.int64()))], names_of)

    schema = f"doc {kind}, n bigint, node bigint, other bigint, counts array<bigint>"
    made = stored(docs.select(F.col(key).alias("doc"), text).mapInArrow(run, schema), "sets")
    sums = made.filter("counts is not null").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    table = stored(sums, "counts").toPandas()
    counts[table["bucket"].to_numpy(dtype=np.int64)] = table["n"].to_numpy(dtype=np.int64)
    return made.filter("counts is null").drop("counts"), counts


def prefix(one: np.ndarray, crowd: np.ndarray, partners: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The places of a set's prefix in it, its l and the place of its last shingle in the order of all, in 16 bits. ``one``: the shingles in
    order; ``crowd``: the class of each shingle's bucket; ``partners``: what each may bring."""
    n = len(one)
    order, least = np.argsort(crowd, kind="stable"), least_shared(n)
    partners = np.cumsum(partners[order])
    best, chosen = None, 1
    l = max(1, n // LEAST_PART)
    while l <= least:
        size = n - least + l
        cost = size + max(LEAST_COST, n) * int(partners[size - 1]) / l
        if best is None or cost < best:
            best, chosen = cost, l
        l *= 2
    last = order[n - least + chosen - 1]
    return order[: n - least + chosen], chosen, int(crowd[last]) << 11 | int(one[last] >> np.uint64(53))


def others(values: np.ndarray) -> np.ndarray:
    """How many more times each value is there."""
    order = np.argsort(values)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(values[order]) != 0]))
    times = np.diff(starts, append=len(values))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.repeat(times - 1, times)
    return out


def heavy_buckets(counts: np.ndarray) -> np.ndarray:
    return counts > 8 * counts.mean() + 64


Rows = tuple[np.ndarray, ...]  # token, node, n, l, end, pos, heavy


def prefix_rows(batches: Iterator[pa.RecordBatch], crowd: np.ndarray, heavy: np.ndarray) -> Iterator[Rows]:
    """The rows of all prefixes of the texts in the first column; copies inside one task come once."""
    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole, 0, UNIT_BYTES):
            values, starts = sets(batch, 0)
            own: dict[int, tuple[int, int]] = {}
            for node, a, b in zip(names(values, starts)[:, 0].tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if a < b and node not in seen:
                    own[node] = a, b
                    seen.add(node)
            if len(seen) > MOST_SEEN:
                seen = set()
            if not own:
                continue
            values = np.concatenate([values[a:b] for a, b in own.values()])
            class_ = crowd[bucket(values)]
            partners = np.maximum(others(values), (1 << class_.astype(np.int64)) - 1)
            columns: list[list] = [[], [], [], [], []]
            at = 0
            for node, (a, b) in own.items():
                n, its = b - a, slice(at, at + b - a)
                kept, l, end = prefix(values[its], class_[its], partners[its])
                for c, v in zip(columns, (kept + at, node, n, l, end), strict=True):
                    c.append(v)
                at += n
            sizes = [len(x) for x in columns[0]]
            token = values[np.concatenate(columns[0])]
            rest = [np.repeat(np.array(c, dtype=t), sizes) for c, t in zip(columns[1:], (np.int64, np.int32, np.int32, np.int32), strict=True)]
            rest.append(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]))
            for at in range(0, len(token), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield token[part], *[c[part] for c in rest], heavy[bucket(token[part])]


def crowding(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each bucket, and which are heavy."""
    mean = counts.mean()
    excess = np.maximum(counts - mean - 4 * np.sqrt(mean + 1), 0)
    return np.floor(np.log2(1 + excess)).astype(np.int8), heavy_buckets(counts)


def postings(docs: DataFrame, counts: np.ndarray, text: str) -> DataFrame:
    """``(token, node, n, l, end, pos, heavy)`` of all prefixes, ``pos`` being the place in the order of the set; copies inside one task come once."""
    crowded = docs.sparkSession.sparkContext.broadcast(crowding(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, *rest in prefix_rows(batches, *crowded.value):
            yield pa.RecordBatch.from_arrays([pa.array(signed(token)), *map(pa.array, rest)], ["token", "node", "n", "l", "end", "pos", "heavy"])

    return docs.select(text).mapInArrow(run, "token bigint, node bigint, n int, l int, end int, pos int, heavy boolean")


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def packed(token: np.ndarray, node: np.ndarray, rest: list[np.ndarray], pos: np.ndarray) -> tuple[int, int, bytes]:
    """Rows in the order of their tokens as ``(rows, nodes, bytes)``: differences of tokens and, where nodes come twice or more on the
    average, each node once and its number in every row."""
    first, number = np.arange(len(token)), None
    once, at, of = np.unique(node, return_index=True, return_inverse=True)
    if 2 * len(once) <= len(node):
        first, number = at, of.astype(np.uint32)
    parts = [np.diff(token, prepend=np.uint64(0)), pos, node[first], *[c[first] for c in rest]] + ([] if number is None else [number])
    return len(token), len(first), pa.compress(b"".join(map(planes, parts)), codec="zstd", asbytes=True)


def unpacked(rows: int, nodes: int, data: pa.Buffer) -> list[np.ndarray]:
    """``[token, node, n, l, end, pos]`` of packed rows."""
    kinds = [(np.uint64, rows), (np.int32, rows), (np.int64, nodes), *[(np.int32, nodes)] * 3] + ([(np.uint32, rows)] if nodes < rows else [])
    sizes = [np.dtype(t).itemsize * k for t, k in kinds]
    raw, ends = np.frombuffer(pa.decompress(data, sum(sizes), codec="zstd"), dtype=np.uint8), np.cumsum(sizes)
    cut = [raw[end - size : end].reshape(-1, k).T.copy().view(t).ravel() for (t, k), size, end in zip(kinds, sizes, ends, strict=True)]
    of = cut[6] if nodes < rows else slice(None)
    return [np.cumsum(cut[0], dtype=np.uint64), *[c[of] for c in cut[2:6]], cut[1]]


def ranges(counts: np.ndarray) -> tuple[int, int]:
    """Among how many ranges the shingles of ordinary and of crowded buckets are dealt."""
    heavy = heavy_buckets(counts)
    return tuple(1 + int(counts[of].sum()) // RANGE_ROWS for of in (~heavy, heavy))


PACKS = "range int, rows int, nodes int, data binary"


def packs(rows: Iterator[Rows], dealt: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Prefix rows in packed ranges of tokens, as ``PACKS``."""
    ordinary, crowded_ = dealt

    def blobs(held: list[Rows]) -> pa.RecordBatch:
        token, node, n, l, end, pos, heavy = map(np.concatenate, zip(*held, strict=True))
        with np.errstate(over="ignore"):
            apart = mixed(token ^ mixed(node.view(np.uint64))) if heavy.any() else token
        high = (np.where(heavy, apart, token) >> np.uint64(32)) * np.where(heavy, crowded_, ordinary).astype(np.uint64)
        range_ = (high >> np.uint64(32)).astype(np.int64) + np.where(heavy, ordinary, 0)
        order = np.lexsort((token, range_)) if heavy.any() else np.argsort(token)  # ordinary ranges follow the tokens
        token, node, n, l, end, pos, range_ = (c[order] for c in (token, node, n, l, end, pos, range_))
        starts = np.flatnonzero(np.diff(range_, prepend=-1))
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(range_)], strict=True):
            out.append((int(range_[a]), *packed(token[a:b], node[a:b], [n[a:b], l[a:b], end[a:b]], pos[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["range", "rows", "nodes", "data"])

    held, n_rows = [], 0
    for some in rows:
        held, n_rows = [*held, some] if len(some[0]) else held, n_rows + len(some[0])
        if n_rows >= PACK_ROWS:
            yield blobs(held)
            held, n_rows = [], 0
    if held:
        yield blobs(held)


def packed_prefixes(docs: DataFrame, counts: np.ndarray, text: str, dealt: tuple[int, int]) -> DataFrame:
    """``PACKS`` of all prefixes, made from the texts in one Python worker a task; rows of prefixes never cross to the JVM."""
    crowded = docs.sparkSession.sparkContext.broadcast(crowding(counts))
    return docs.select(text).mapInArrow(lambda batches: packs(prefix_rows(batches, *crowded.value), dealt), PACKS)


def shared(posted: DataFrame, any_heavy: bool, dealt: tuple[int, int] = (1, 1)) -> DataFrame:
    """``met`` of ``posted (token, node, n, l, end, pos, heavy)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for batch in batches:
            token, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "node", "n", "l", "end", "pos", "heavy"))
            yield token.view(np.uint64), *rest

    return met(posted.mapInArrow(lambda batches: packs(rows(batches), dealt), PACKS), any_heavy, dealt)


def met(blobs: DataFrame, any_heavy: bool, dealt: tuple[int, int]) -> DataFrame:
    """``(token, node, n, l, end, pos)`` of tokens that more than one node has. Sets are made and sent once, for all tokens, in packed
    ranges of tokens: those of ordinary buckets, whose number of rows the bucket counts bound, are looked at together; a row of a
    crowded bucket goes by token and node, so that no task gets all of a frequent token, and is held against an aggregate that is
    combined before the shuffle, in a join that can be split. The rows of copies in other tasks go in the same step."""
    columns = ["token", "node", "n", "l", "end", "pos"]
    ordinary = dealt[0]

    def meet(table: pa.Table) -> pa.Table:
        heavy = table.column("range")[0].as_py() >= ordinary
        found = [unpacked(rows, nodes, data.as_buffer()) for rows, nodes, data in zip(table.column("rows").to_pylist(), table.column("nodes").to_pylist(), table.column("data"), strict=True)]
        token, node, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
        if heavy:
            order = np.lexsort((node, token))
        else:
            order = np.argsort(token)
            same = np.diff(token[order]) == 0
            order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            order = order[np.lexsort((node[order], token[order]))]
        token, node = token[order], node[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, order = token[new], node[new], order[new]
        if not heavy:
            same = token[1:] == token[:-1]
            often = (np.concatenate([same, [False]]) | np.concatenate([[False], same]))[: len(token)]
            token, node, order = token[often], node[often], order[often]
        return pa.table([signed(token), node, *[c[order] for c in rest], np.full(len(token), heavy)], [*columns, "heavy"])

    rows = stored(blobs.groupBy("range").applyInArrow(meet, "token bigint, node bigint, n int, l int, end int, pos int, heavy boolean"), "posted")
    if not any_heavy:
        return rows.select(*columns)
    crowded = rows.filter("heavy").select(*columns)
    ends = crowded.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("top")).filter("low <> top").select("token")
    return rows.filter("not heavy").select(*columns).unionAll(crowded.join(ends, "token", "left_semi").select(*columns))


def promising(posted: DataFrame) -> DataFrame:
    """The rows of nodes that can be in a candidate pair: a node's shared tokens reach its own l or the least l among
    the nodes that it shares one with."""
    least = posted.groupBy("token").agg(F.min("l").alias("low"))
    nodes = posted.join(least, "token").groupBy("node").agg(F.count("*").alias("n_shared"), F.min("low").alias("low"))
    return posted.join(nodes.filter(F.col("n_shared") >= F.col("low")).select("node"), "node", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, one: DataFrame, key: str, text: str) -> DataFrame:
    """Of pairs ``(a, b)`` those whose sets reach the threshold; ``one``: a document for each node. Only the sets of
    the pairs' nodes are made."""
    pairs = stored(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    whole = whole_sets(docs, stored(one.join(nodes, "node").select("doc"), "wanted"), key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(100 * both >= SHARE * (len(x) + len(y) - both) and both > 0)
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    met = pairs.join(whole.select(F.col("node").alias("b"), F.col("set").alias("right")), "b")
    met = met.join(whole.select(F.col("node").alias("a"), F.col("set").alias("left")), "a").select("a", "b", "left", "right")
    return met.mapInArrow(run, "a bigint, b bigint")


def whole_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``(node, set)`` of the rows in ``wanted (doc)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, UNIT_BYTES):
                values, starts = sets(batch, 0)
                each = [values[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names(values, starts)[:, 0]), pa.array(each, pa.binary())], ["node", "set"])

    chosen = docs.select(F.col(key).alias("doc"), text).join(wanted, "doc", "left_semi").select(text)
    return stored(chosen.mapInArrow(run, "node bigint, set binary").dropDuplicates(["node"]), "whole")


def possible(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Of pairs ``(a, b)`` the candidates: their whole prefixes share the smaller l at least. Where x's prefix ends before y's in
    the order of all shingles, each shingle of x's prefix that y's lacks is one that y lacks; the threshold allows n_x less
    the least overlap of them. So whole sets, many times as long, are made for few of the pairs that meet."""
    for s in "ab":
        pairs = pairs.join(prefixes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("tokens", "n", "l", "end")]), s)
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    overlap = F.ceil(SHARE * (F.col("n_a") + F.col("n_b")) / (100 + SHARE))
    asked = lambda s: overlap - F.ceil(SHARE * F.col(f"n_{s}") / 100) + F.col(f"l_{s}")
    least = F.when(F.col("end_a") < F.col("end_b"), asked("a")).when(F.col("end_b") < F.col("end_a"), asked("b")).otherwise(F.least(asked("a"), asked("b")))
    return pairs.filter((both >= F.least("l_a", "l_b")) & (both >= least)).select("a", "b")


def met_by_hubs(posted: DataFrame, component: DataFrame | None, turn: int) -> DataFrame:
    """Pairs of a node and, for each of ``HUBS`` random orders, the hub that shares most tokens with it; a token's hub is its
    first node in that order. Only tokens of more than one component count. There are no more pairs ``(a node, b hub)`` than ``HUBS`` a node."""
    known = posted.withColumn("component", F.col("node"))
    if component is not None:
        known = posted.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    hubs = [F.min_by("node", F.xxhash64("node", F.lit(turn * HUBS + k))).alias(f"hub{k}") for k in range(HUBS)]
    ends = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), *hubs).filter("low <> high")
    met = known.join(ends, "token").select("node", "l", F.posexplode(F.array(*[f"hub{k}" for k in range(HUBS)])).alias("k", "hub")).filter("node <> hub")
    met = met.groupBy("node", "hub", "k").agg(F.count("*").alias("both"), F.min("l").alias("l"))
    best = met.groupBy("node", "k").agg(F.max_by("hub", F.struct("both", "hub")).alias("hub"))
    once = best.groupBy(F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y")).agg(F.min("node").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))


def chained(links: DataFrame) -> DataFrame:
    """Links that join the same components as ``(a node, b hub)``: a node keeps one of its ``HUBS`` links at most, and its hubs are linked with each
    other. A large group has few hubs, so that about one link a node is left."""
    low = F.min("b").over(Window.partitionBy("a"))
    return links.withColumn("low", low).select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("low")).alias("a"), "b").distinct()


def between(posted: DataFrame, component: DataFrame) -> DataFrame:
    """Candidate pairs of nodes in different components.

    Let x be the larger set of a pair and y the smaller one. A pair that links shares 2 * 0.75 / 1.75 of y's shingles at
    least and 0.75 of x's. So with r = max(1, m / LEAST_PART), which neither l is below, its first r shared shingles lie among the
    first m - ceil(0.857 m) + r of y and the first n - ceil(0.75 n) + r of x. The one of these r that the fewest nodes have is
    still there after y has laid its r - 1 most frequent ones aside, and x as many as any y asks; only on such rows do
    pairs meet. What follows such a shingle in both orders, with r, has to reach the overlap that the threshold asks. A pair
    that meets on many shingles has most of them one soon after the other: a row carries the ``LOOK_BACK`` shingles before it, and where one
    of them is common the pair met there, since more follows it in both orders."""
    known = posted.join(component, "node", "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("component"))
    ends = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("often"))
    open_ = stored(known.join(ends.filter("low <> high").select("token", "often"), "token"), "open")
    n, pos = F.col("n"), F.col("pos")
    asked_of = lambda size: F.greatest(F.lit(1), F.floor(size / LEAST_PART)).cast("int")
    as_larger = pos < n - F.ceil(SHARE * n / 100) + asked_of(n)
    as_smaller = pos < n - F.ceil(2 * SHARE * n / (100 + SHARE)) + asked_of(n)
    frequent = Window.partitionBy("node").orderBy(F.desc("often"), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda inside: F.sum(inside.cast("int")).over(frequent)
    placed = open_.select("token", "node", "n", "pos", "component", as_larger.alias("larger"), as_smaller.alias("smaller"), place(as_larger).alias("at_larger"), place(as_smaller).alias("at_smaller"))
    larger = F.col("larger") & (F.col("at_larger") >= asked_of(F.ceil(SHARE * n / 100)))
    smaller = F.col("smaller") & (F.col("at_smaller") >= asked_of(n))
    rows = placed.select("token", "node", "n", "pos", "component", (n - pos - 1).alias("behind"), asked_of(n).alias("r"), larger.alias("larger"), smaller.alias("smaller")).filter("larger or smaller")
    earlier = Window.partitionBy("node").orderBy("pos").rowsBetween(-LOOK_BACK, -1)
    before = [F.collect_list(F.when(F.col(role), F.col("token"))).over(earlier).alias(f"before_{role}") for role in ("larger", "smaller")]
    rest = stored(rows.select("token", "node", "n", "component", "behind", "r", "larger", "smaller", *before), "rest")
    a, b = (rest.filter(role).select("token", F.col(f"before_{role}").alias(f"before_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "component", "behind", "r")]) for role, s in (("larger", "a"), ("smaller", "b")))
    enough = b["r_b"] + F.least(a["behind_a"], b["behind_b"]) >= F.ceil(SHARE * (a["n_a"] + b["n_b"]) / (100 + SHARE))
    fits = ((b["n_b"] < a["n_a"]) | ((b["n_b"] == a["n_a"]) & (b["node_b"] < a["node_a"]))) & (a["component_a"] != b["component_b"]) & (100 * b["n_b"] >= SHARE * a["n_a"]) & enough & ~F.arrays_overlap(a["before_a"], b["before_b"])
    return a.join(b, (a["token"] == b["token"]) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id)`` of each row; the component's id is its smallest key (an integer)."""
    docs = docs.select(key, text)
    described_, counts = described(docs, key, text)
    dealt = ranges(counts)
    posted = met(packed_prefixes(docs, counts, text, dealt), bool(heavy_buckets(counts).any()), dealt)
    lists = [F.collect_list("token").alias("tokens"), F.collect_list("pos").alias("places")]
    prefixes = stored(promising(posted).groupBy("node").agg(*lists, *[F.min(c).alias(c) for c in ("n", "l", "end")]), "prefixes")
    posted = prefixes.select("node", "n", "l", "end", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("places").alias("pos"))))
    one = stored(described_.filter("n > 0").groupBy("node").agg(F.min("doc").alias("doc")), "nodes")
    joined = None
    of_before = lambda: joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for turn in range(ROUNDS):
        links = chained(confirmed(possible(met_by_hubs(posted, joined, turn), prefixes), docs, one, key, text))
        joined = components(stored(links if joined is None else links.unionAll(of_before()), "first"))
    more = stored(confirmed(possible(between(posted, joined), prefixes), docs, one, key, text), "second")
    if more.limit(1).count():
        joined = components(of_before().unionAll(more))
    node = one.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc")
    least = node.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = stored(node.join(least, "component").select("node", "component_id"), "named")
    out = described_.join(named, "node", "left")
    of_none = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), of_none.alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all columns of which one stays of each class: the one with the smallest key, rows without words
    all. Of rows with that same key the class keeps each whose text it is; equal keys are not expected."""
    gone = classes(docs, key, text).filter(F.col("component_id") < F.col(key)).select(key).distinct()
    return docs.join(gone, key, "left_anti")
