"""Ranked lexical search over trees of document term vectors.

Documents are cut down to the items' terms, in descending order of the terms' document frequency, so that sorted vectors share
the paths of a trie. A node covers the documents below it (adjacent in that order) and keeps the greatest tf of each term and
the least m among them; both bound what a document there can score, since a score rises with tf and falls with m.
Per item, a tree is searched depth first, best child first, and a subtree is left out when its bound cannot displace the
item's k-th document (by score, then id). Single paths are compressed, and adjacent small subtrees share a leaf of at most
``LEAF`` documents, which are scored exactly; no document that could count is skipped.

Items are taken in blocks with at most ``BLOCK_TERMS`` different terms and ``BLOCK_ITEMS`` items (one item at least), each block
one pass over the documents; so what tasks receive has a fixed bound, whatever the number of items. A task builds a tree
for each ``TREE_DOCS`` documents or ``TREE_CELLS`` entries, whichever comes first, and holds k documents an item. Terms are compared by 128 bits
of hash.

Defined cases: null texts have no terms; documents without terms, or with a null id, are counted as N, L and df say but
never returned; rows that share an id are documents of their own, and items that share one are items of their own, as are those
with a null id; equal scores go by ascending id; very long texts are taken whole; an empty table on either side gives an
empty result; other columns are never read."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, hashes, slices, spans, stored, utf8

K = 20
BLOCK_TERMS, BLOCK_ITEMS = 20_000, 2_000
TREE_DOCS, TREE_CELLS, LEAF = 8_192, 1 << 20, 64
#: Shares of the tasks' results that are ranked before an item's documents meet.
SALTS = 64

#: Bytes of terms: digits, letters, and all bytes of characters beyond ASCII.
TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_PAIR = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _terms(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 128-bit hash of each term."""
    data = LOWER[data]
    text, begin, end = spans(offsets, data, TERM)
    out = np.empty(len(text), dtype=_PAIR)
    out["a"], out["b"] = hashes(data, begin, end), hashes(data, begin, end, 1)
    return text, out


class Block:
    """Some items and the vocabulary that their terms make."""

    def __init__(self):
        self.ids, self.texts, self.seen = [], [], set()

    def takes(self, row) -> bool:
        """Add the item, unless the block is full."""
        _, terms = _terms(*utf8(pa.array([row["text"]], pa.large_string())))
        new = set(terms.tolist())
        if self.ids and (len(self.ids) >= BLOCK_ITEMS or len(self.seen | new) > BLOCK_TERMS):
            return False
        self.ids.append(row["id"])
        self.texts.append(terms)
        self.seen |= new
        return True

    def vocabulary(self) -> np.ndarray:
        return np.sort(np.array(list(self.seen), dtype=_PAIR), order=("a", "b"))


def blocks(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    block = Block()
    for row in items.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).toLocalIterator():
        if not block.takes(row):
            yield block
            block = Block()
            block.takes(row)
    if block.ids:
        yield block


def _restricted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(id, n, terms, tfs)``: terms by their place in the vocabulary, ascending, with their occurrences."""
    first = vocabulary["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                rows = some.num_rows
                text, terms = _terms(*utf8(some.column(1)))
                n = np.bincount(text, minlength=rows).astype(np.int64)
                # Two terms may share the first half of the hash; the whole is compared from there on.
                at = np.searchsorted(first, terms["a"])
                hit = np.zeros(len(text), dtype=bool)
                live = np.flatnonzero(at < len(first))
                while len(live):
                    live = live[first[at[live]] == terms["a"][live]]
                    same = vocabulary["b"][at[live]] == terms["b"][live]
                    hit[live[same]] = True
                    live = live[~same]
                    at[live] += 1
                    live = live[at[live] < len(first)]
                cell, tf = np.unique(text[hit] * np.int64(max(len(first), 1)) + at[hit], return_counts=True)
                owner, term = np.divmod(cell, max(len(first), 1))
                cuts = np.searchsorted(owner, np.arange(rows + 1))
                pieces = [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (term.astype(np.int32), tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), *pieces], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "id bigint, n bigint, terms binary, tfs binary")


def _frequencies(restricted: DataFrame, size: int) -> np.ndarray:
    """df of each term, counted in each task and added up by term: ``size`` rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            _, flat = _flat(batch.column(0))
            total += np.bincount(flat, minlength=size)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for row in restricted.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each row's list of 32-bit numbers, and all of them."""
    parts = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in column]
    return np.array([len(x) for x in parts], dtype=np.int64), np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


class Tree:
    """The trie of some documents' term vectors. ``rank`` orders the terms; ``m`` is each document's length norm."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, tfs: np.ndarray):
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((ranks, owner))
        ranks, tfs = ranks[order], tfs[order].astype(np.int64)
        start = np.append(0, np.cumsum(sizes))
        raw, width = ranks.astype(">u4").tobytes(), 4
        path = [raw[width * a : width * b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
        # By path, then by id: what lies under a node is one range of documents.
        sorted_docs = sorted(range(len(ids)), key=lambda d: (path[d], ids[d]))
        self.path = [path[d] for d in sorted_docs]
        by = np.array(sorted_docs, dtype=np.int64)
        self.ids, self.m, size = ids[by], m[by], sizes[by]
        self.start = np.append(0, np.cumsum(size))
        cell = np.repeat(start[by] - self.start[:-1], size) + np.arange(self.start[-1])
        self.columns, self.column = np.unique(ranks[cell], return_inverse=True)
        self.depth, tf = size, tfs[cell]
        self.part = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(self.m, size))
        self._grow()
        self._bounds(tf)

    def _common(self, low: int, high: int, depth: int) -> int:
        """Terms that the paths of [low, high) share at least, known to be ``depth`` or more: sorted, its ends decide."""
        a, b = (self.column[self.start[d] + depth : self.start[d + 1]] for d in (low, high - 1))
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        return depth + (int(other[0]) if len(other) else n)

    def _ranges(self, low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """The subtrees of a node as (low, high, depth); one that leaves fewer than ``LEAF`` documents beside it is replaced by its own."""
        out, rest = [], []
        while True:
            depth = self._common(low, high, depth)
            own = low + int(np.searchsorted(self.depth[low:high] > depth, True))
            term = self.column[self.start[own:high] + depth] if own < high else np.zeros(0, dtype=np.int64)
            cuts = [own, *(own + 1 + np.flatnonzero(np.diff(term))).tolist(), high] if own < high else [own]
            found = ([(low, own, depth)] if own > low else []) + [(a, b, depth + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            heavy = max(range(len(found)), key=lambda i: found[i][1] - found[i][0])
            a, b, below = found[heavy]
            if b - a <= LEAF or (high - low) - (b - a) >= LEAF or below == depth:
                return out + found + rest[::-1]
            out, rest = out + found[:heavy], rest + found[:heavy:-1]
            low, high, depth = a, b, below

    def _grow(self) -> None:
        """Nodes with their ranges and children; children come after their parent."""
        self.low, self.high, self.children = [0], [len(self.ids)], [None]
        waiting = [(0, 0)]
        while waiting:
            node, depth = waiting.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            ranges = self._ranges(low, high, depth)
            if len(ranges) == 1:  # all end here: the same terms throughout
                continue
            first, at = len(self.low), 0
            while at < len(ranges):
                a, b, below = ranges[at]
                at += 1
                if b - a <= LEAF:
                    while at < len(ranges) and ranges[at][1] - a <= LEAF:
                        b = ranges[at][1]
                        at += 1
                elif below > depth and self.depth[a : b].max() >= below:
                    waiting.append((len(self.low), below))
                self.low.append(a)
                self.high.append(b)
                self.children.append(None)
            self.children[node] = np.arange(first, len(self.low))

    def _bounds(self, tf: np.ndarray) -> None:
        """For each node what each term adds at most, and its least id."""
        nodes = len(self.low)
        greatest = np.zeros((nodes, len(self.columns)), dtype=np.int64)
        least, self.least_id = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
        for v in range(nodes - 1, -1, -1):
            low, high, below = self.low[v], self.high[v], self.children[v]
            least[v], self.least_id[v] = self.m[low:high].min(), self.ids[low:high].min()
            if below is None:
                a, b = self.start[low], self.start[high]
                np.maximum.at(greatest[v], self.column[a:b], tf[a:b])
            else:
                greatest[v] = greatest[below].max(axis=0)
        self.bound = 1_000_000_000 * greatest // np.maximum(1000 * greatest + 12 * least[:, None], 1)

    def search(self, terms: np.ndarray, gains: np.ndarray, best: Best) -> None:
        """Offer all documents that may belong to the best for terms with these gains."""
        at = np.searchsorted(self.columns, terms)
        has = at < len(self.columns)
        has[has] = self.columns[at[has]] == terms[has]
        at, gains = at[has], gains[has]
        if not len(at):
            return
        dense = np.zeros(len(self.columns), dtype=np.int64)
        dense[at] = gains
        stack = [(int(self.bound[0, at] @ gains), 0)]
        while stack:
            bound, node = stack.pop()
            if not best.open(bound, self.least_id[node]):
                continue
            below = self.children[node]
            if below is None:
                low, high = self.low[node], self.high[node]
                a, b = self.start[low], self.start[high]
                best.offer(np.add.reduceat(dense[self.column[a:b]] * self.part[a:b], self.start[low:high] - a), self.ids[low:high])
            else:
                bounds = self.bound[np.ix_(below, at)] @ gains
                order = np.argsort(bounds, kind="stable")
                stack += zip(bounds[order].tolist(), below[order].tolist(), strict=True)


class Best:
    """The k best documents of one item."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def open(self, bound: int, least_id: int) -> bool:
        if bound <= 0:
            return False
        return len(self.ids) < self.k or bound > self.score[-1] or (bound == self.score[-1] and least_id < self.ids[-1])

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score > 0 if len(self.ids) < self.k else score >= self.score[-1]
        if keep.any():
            score, ids = np.concatenate([self.score, score[keep]]), np.concatenate([self.ids, ids[keep]])
            order = np.lexsort((ids, -score))[: self.k]
            self.score, self.ids = score[order], ids[order]


def _searched(restricted: DataFrame, block: Block, vocabulary: np.ndarray, df: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: for each item of the block, the best documents of each task."""
    rank = np.empty(len(df), dtype=np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    items = []
    for terms in block.texts:
        term, times = np.unique(np.searchsorted(vocabulary, terms), return_counts=True)
        order = np.argsort(rank[term])
        items.append((rank[term][order], (weight[term] * times)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, cells = [Best(k) for _ in items], [], 0

        def search() -> None:
            tree = Tree(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for (terms, gains), one in zip(items, best, strict=True):
                tree.search(terms, gains, one)

        for batch in batches:
            for at in range(0, batch.num_rows, TREE_DOCS // 8):
                some = batch.slice(at, TREE_DOCS // 8)
                sizes, flat = _flat(some.column(2))
                m = 75 + 25 * some.column(1).to_numpy() * documents // length
                held.append((some.column(0).to_numpy(), m, sizes, rank[flat], _flat(some.column(3))[1]))
                cells += len(flat)
                if cells > TREE_CELLS or sum(len(x[0]) for x in held) >= TREE_DOCS:
                    search()
                    held, cells = [], 0
        if held:
            search()
        item = np.repeat(np.arange(len(items)), [len(b.ids) for b in best])
        columns = [pa.array(item)] + [pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x])) for x in ([b.ids for b in best], [b.score for b in best])]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return restricted.filter("id is not null and length(terms) > 0").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each item with a score above 0."""
    spark, facts, out = docs.sparkSession, None, []
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    by_score = (F.desc("score"), "doc_id")
    for block in blocks(items, item_key, text):
        vocabulary = block.vocabulary()
        restricted = stored(_restricted(texts, vocabulary), "search-vectors")
        if facts is None:
            facts = restricted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("length")).first()
        if not facts["documents"] or not len(vocabulary):
            continue
        found = stored(_searched(restricted, block, vocabulary, _frequencies(restricted, len(vocabulary)), facts["documents"], facts["length"], k), "search-found")
        share = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*by_score)
        some = found.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= k).drop("rank")
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by_score))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item bigint, item_id bigint")
        out.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole


def search_sql(k: int = K) -> str:
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    found = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    with d as (select doc_id, {found} as terms from documents),
    g as (select count(*) as big_n, sum(len(terms))::bigint as big_l from d where len(terms) > 0),
    q as (select item_id, term, count(*) as times from (select item_id, unnest({found}) as term from benchmark) group by all),
    t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from d) where term in (select term from q) group by all),
    w as (select term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::bigint as weight from t, g group by term, big_n),
    m as (select doc_id, 75 + (25 * len(terms) * big_n) // big_l as m from d, g where len(terms) > 0),
    s as (
      select item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
      from q join t using (term) join w using (term) join m using (doc_id) group by all
    )
    select item_id, (row_number() over i)::int as rank, doc_id, score from s where score > 0
    window i as (partition by item_id order by score desc, doc_id)
    qualify row_number() over i <= {k}
    """
