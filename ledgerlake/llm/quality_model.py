"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is binned at quantiles. Rounds of boosting go over the features in turn; in each turn a tree of a few cuts over
one feature's bins is fitted to the gradient of the log loss and its leaves are added to the feature's lookup table. The
pairs whose four quadrants explain most of what is left then get tables of two features, by trees of one cut in
each. A document's score is the logistic function of the sum of its table entries, for whole batches at once.

The model is fitted on the driver from a sample of at most ``SAMPLE`` labelled rows (those with the least hash of the key), whatever
the input; features and scores are computed in the tasks, from the text alone. Nothing is shuffled but labels.

Defined cases: null and empty texts have zero counts and get a score as any other; of several labels of one key the greatest
counts, null labels none; without labels of both kinds every score is the share of label 1, or 0.5; repeated rows score alike."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grams, hashes, mixed, slices, spans, utf8

SAMPLE, BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 20_000, 64, 150, 0.1, 6, 12, 40

#: Byte classes: letters are what none of these takes.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>@^_~{}[]+=/\\", "bar": b"|", "shout": b"!?", "point": b".,;:'\"()-", "space": b" \t\n\x0b\x0c\r"}
_CODE = np.zeros(256, dtype=np.int64)
for _k, _set in enumerate(_CLASSES.values()):
    _CODE[list(_set)] = _k + 1
_CODE[128:] = len(_CLASSES) + 1

FEATURES = ("words", "word_length", "upper", "digit", "symbol", "bar", "shout", "point", "beyond", "words_a_line", "repeated_lines", "distinct_words", "repeated_grams", "top_word")


def features(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """(rows, features) of the texts of a batch."""
    out = []
    for part in slices(batch, column):
        offsets, data = utf8(part.column(column))
        rows, size = part.num_rows, np.maximum(np.diff(offsets), 1)
        owner = np.repeat(np.arange(rows), np.diff(offsets))
        kinds = len(_CLASSES) + 2
        share = np.bincount(owner * kinds + _CODE[data], minlength=rows * kinds).reshape(rows, kinds) / size[:, None]
        text, begin, end = spans(offsets, data)
        word = hashes(data, begin, end)
        n = np.bincount(text, minlength=rows)
        length = np.bincount(text, weights=end - begin, minlength=rows) / np.maximum(n, 1)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, begin)
        first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 0))
        with np.errstate(over="ignore"):
            place = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
            line_hash = np.add.reduceat(mixed(word + place.astype(np.uint64)), first) if len(first) else word
        of_line = text[first]
        gram_text, gram = grams(text, word, 3)
        cuts = [np.searchsorted(x, np.arange(rows + 1)).tolist() for x in (of_line, text, gram_text)]
        more = np.zeros((rows, 5))
        for k in range(rows):
            (a, b), (c, d), (e, f) = ((x[k], x[k + 1]) for x in cuts)
            if d > c:
                times = np.unique(word[c:d], return_counts=True)[1]
                more[k] = ((d - c) / (b - a), 1 - len(np.unique(line_hash[a:b])) / (b - a), len(times) / (d - c), 1 - len(np.unique(gram[e:f])) / (f - e), times.max() / (d - c))
        out.append(np.column_stack([np.log1p(n), length, share[:, 1:7], share[:, 8], more]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3, ridge: float = 5.0) -> np.ndarray:
    """Leaf values by bin of a tree over one feature's bins: the best cut, again and again, up to ``leaves`` leaves."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    ends = [0, len(gradient)]
    while len(ends) <= leaves:
        best = (1e-9, -1)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a > 1:
                at = np.arange(a + 1, b)
                more = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(np.argmax(more))
                best = max(best, (float(more[k]), int(at[k])))
        if best[1] < 0:
            break
        ends = sorted([*ends, best[1]])
    values = np.zeros(len(gradient))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        values[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return values


def _quadrants(gradient: np.ndarray, weight: np.ndarray, ridge: float = 5.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut in each direction of a table of two features."""
    g, h = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (gradient, weight))
    n, m = gradient.shape
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    corner = lambda x: (x[i, j], x[n, j] - x[i, j], x[i, m] - x[i, j], x[n, m] - x[n, j] - x[i, m] + x[i, j])
    parts = list(zip(corner(g), corner(h), strict=True))
    gain = sum(a**2 / (b + ridge) for a, b in parts) - g[n, m] ** 2 / (h[n, m] + ridge)
    p, q = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [a[p, q] / (b[p, q] + ridge) for a, b in parts]
    values = np.empty((n, m))
    values[: p + 1, : q + 1], values[p + 1 :, : q + 1], values[: p + 1, q + 1 :], values[p + 1 :, q + 1 :] = leaf[0], leaf[1], leaf[2], leaf[3]
    return float(gain[p, q]), values


class Model:
    """Cut points, lookup tables of features and of pairs, and the constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = float(y.mean()) if len(y) else 0.5
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(y) else [np.zeros(1)] * len(FEATURES)
        self.pair_cuts = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T] if len(y) else [np.zeros(1)] * len(FEATURES)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.base = float(np.log(share / (1 - share))) if 0 < share < 1 else None
        self.share = share
        if self.base is not None:
            self._fit(x, y.astype(np.float64))

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins = [np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)]
        total = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for table, b in zip(self.tables, bins, strict=True):
                g, h = slopes()
                step = RATE * _tree(np.bincount(b, weights=g, minlength=len(table)), np.bincount(b, weights=h, minlength=len(table)))
                table += step
                total += step[b]
        coarse = [np.searchsorted(c, v, "right") for c, v in zip(self.pair_cuts, x.T, strict=True)]

        def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
            n, m = len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1
            return np.bincount(coarse[i] * m + coarse[j], weights=values, minlength=n * m).reshape(n, m)

        g, h = slopes()
        able = [k for k, c in enumerate(self.pair_cuts) if len(c)]
        ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(able, 2)), reverse=True)
        self.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                g, h = slopes()
                step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
                table += step
                total += step[coarse[i], coarse[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is None:
            return np.full(len(x), self.share)
        total = np.full(len(x), self.base)
        for table, cuts, v in zip(self.tables, self.cuts, x.T, strict=True):
            total += table[np.searchsorted(cuts, v, "right")]
        coarse = [np.searchsorted(c, v, "right") for c, v in zip(self.pair_cuts, x.T, strict=True)]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def featured(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = next(f for f in docs.schema.fields if f.name == key).dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["key", "x"])

    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, x array<double>")


def fitted(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows for which ``use``, a condition on the key, holds."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & use).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample)
    # at most ``sample`` keys, so their size is bounded
    rows = featured(docs.join(F.broadcast(chosen), docs[key] == chosen["key"], "left_semi"), key, text).join(F.broadcast(chosen), "key").select("key", "x", "y").collect()
    rows.sort(key=lambda r: (r["key"], r["x"]))
    return Model(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows]))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of each row."""
    kind = next(f for f in docs.schema.fields if f.name == key).dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(features(batch, 1)), pa.float64())], ["key", "score"])

    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
