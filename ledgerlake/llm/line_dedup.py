"""Line dedup by winnowing: repeated runs of lines are found by guaranteed fingerprints and deleted where they come later.

The lines with a word are hashed. A gram is the shortest run of lines from one line on that has ``gram_words`` words; the window
of a line is the shortest run from it on that has ``window_words``. In every window the gram with the least hash is selected,
so any run of lines that two places share and that has ``window_words`` words shares a selected gram too. Equal selected grams are
joined: each later place with the first one (by document, row and line). The match is extended line by line in both
directions, and the later run is deleted. A run inside one document may not overlap its source.

Only hashes are joined (8 bytes a line); texts meet the deleted runs once, and only where they are to be cut. A gram or source that very many documents
have is counted before the shuffle, and the join on it can be split.

Defined cases: a null text has no lines and stays null; blank lines are passed over when runs are compared and go with a
deleted run around them; a document of which no line with a word is left is dropped; of repeated rows the later is a
copy of the first; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, hashes, mixed, signed, slices, spans, stored, utf8

GRAM_WORDS, WINDOW_WORDS = 40, 50

_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, for hashes of runs of lines from prefix sums. Lines are mixed hashes, and a gram
    has ``GRAM_WORDS`` lines at most, so it is no sum of many regular terms."""
    out = []
    for x in (_BASE, _BACK):
        power = np.full(n, x, dtype=np.uint64)
        power[:1] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(power))
    return out[0], out[1]


def line_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: text number, line number in its text, hash of its words, number of words."""
    text, begin, end = spans(offsets, data)
    if not len(text):
        return text, text, np.zeros(0, dtype=np.uint64), text
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, begin)
    line_in_text = line - np.searchsorted(breaks, offsets[text])
    first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 0))
    count = np.diff(np.append(first, len(text)))
    place = np.arange(len(text)) - np.repeat(first, count)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(mixed(hashes(data, begin, end) + place.astype(np.uint64) * _BASE), first)
        return text[first], line_in_text[first], mixed(whole + count.astype(np.uint64)), count


def fingerprints(line: np.ndarray, words: np.ndarray, gram_words: int, window_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line and hash of the selected grams of one text."""
    total = np.cumsum(words)
    before = total - words
    last = np.searchsorted(total, before + gram_words)
    n = int(np.searchsorted(last, len(line)))
    if not n:
        return last[:0], last[:0], line[:0]
    with np.errstate(over="ignore"):
        power, back = _powers(len(line))
        run = np.zeros(len(line) + 1, dtype=np.uint64)
        np.add.accumulate(line * power[: len(line)], out=run[1:])
        start = np.arange(n)
        gram = mixed((run[last[:n] + 1] - run[:n]) * back[:n] + (last[:n] - start).astype(np.uint64))
    end = np.searchsorted(total, before + window_words)
    end = end[end < len(line)]
    top = np.searchsorted(last[:n], end, "right")
    chosen = {i + int(np.argmin(gram[i:j])) for i, j in enumerate(top.tolist()) if j > i}
    at = np.array(sorted(chosen), dtype=np.int64)
    return at, last[at], gram[at]


def extended(later: np.ndarray, first: np.ndarray, at: int, source: int, same: bool) -> tuple[int, int, int]:
    """First line, last line and source line of the longest equal run around two equal lines."""
    limit = at - source if same else None
    a, s = at, source
    while a and s and later[a - 1] == first[s - 1] and (limit is None or at - a + 1 < limit):
        a, s = a - 1, s - 1
    b, e = at, source
    while b + 1 < len(later) and e + 1 < len(first) and later[b + 1] == first[e + 1] and (limit is None or e + 1 < a):
        b, e = b + 1, e + 1
    return a, b, s


def hashed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``(doc, mark, number, words, line, grams, row)`` of each row with a selected gram."""
    kind = next(f for f in docs.schema.fields if f.name == key).dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                offsets, data = utf8(batch.column(2))
                owner, number, line, words = line_hashes(offsets, data)
                cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
                rows, out = [], []
                for k in range(batch.num_rows):
                    part = slice(cuts[k], cuts[k + 1])
                    at, last, gram = fingerprints(line[part], words[part], gram_words, window_words)
                    if len(at):
                        rows.append(k)
                        out.append((number[part], words[part], signed(line[part]), [{"at": a, "gram": g} for a, g in zip(at.tolist(), signed(gram).tolist(), strict=True)]))
                found = list(zip(*out, strict=True)) if out else [()] * 4
                ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
                gram_type = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())]))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)],
                    *[pa.array(list(v), t) for v, t in zip(found, (ints, ints, longs, gram_type), strict=True)],
                ], ["doc", "mark", "number", "words", "line", "grams"])

    mark = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark")
    schema = f"doc {kind}, mark bigint, number array<int>, words array<int>, line array<bigint>, grams array<struct<at:int,gram:bigint>>"
    made = docs.select(F.col(key).alias("doc"), mark, text).mapInArrow(run, schema)
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "lines")


def repeated_runs(lines: DataFrame, gram_words: int = GRAM_WORDS) -> DataFrame:
    """``(doc, mark, row, first, last, words, source, source_first)`` of each match of a later run; runs of a row may overlap.
    ``first`` and ``last`` are line numbers from 0 in the text; ``mark`` is the text's hash; ``source`` is a document."""
    kind = lines.schema["doc"].dataType.simpleString()
    places = lines.select("doc", "row", F.inline("grams"))
    first = places.groupBy("gram").agg(F.min(F.struct("doc", "row", "at")).alias("source"), F.count("*").alias("n")).filter("n > 1")
    later = places.join(first, "gram").filter("not (row = source.row and at = source.at)")
    met = later.groupBy("row", F.col("source.row").alias("source_row"), F.col("source.doc").alias("source")).agg(F.sort_array(F.collect_list(F.struct("at", F.col("source.at").alias("source_at")))).alias("places"))
    met = stored(met, "meetings")
    met = met.join(lines.select("row", "doc", "mark", "number", "words", "line"), "row")
    met = met.join(lines.select(F.col("row").alias("source_row"), F.col("line").alias("source_line"), F.col("number").alias("source_number")), "source_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        for batch in batches:
            rows, owner = [], []
            marks, row_ids, source_ids = (batch.column(c).to_pylist() for c in ("mark", "row", "source_row"))
            for k in range(batch.num_rows):
                number, words, line, source_line, source_number = (batch.column(c)[k].values.to_numpy() for c in ("number", "words", "line", "source_line", "source_number"))
                total, done = np.concatenate([[0], np.cumsum(words)]), -1
                for place in batch.column("places")[k].as_py():
                    if place["at"] <= done and row_ids[k] != source_ids[k]:
                        if rows and rows[-1][5] - rows[-1][2] == source_number[place["source_at"]] - number[place["at"]]:
                            continue  # on the run just found
                    same = row_ids[k] == source_ids[k]
                    if same and place["at"] <= place["source_at"]:
                        continue
                    a, b, s = extended(line, source_line, place["at"], place["source_at"], same)
                    if total[b + 1] - total[a] >= gram_words:
                        owner.append(k)
                        rows.append((marks[k], row_ids[k], int(number[a]), int(number[b]), int(total[b + 1] - total[a]), int(source_number[s])))
                        done = b
            found = list(zip(*rows, strict=True)) if rows else [()] * 6
            taken = [batch.column(c).take(pa.array(owner, pa.int64())) for c in ("doc", "source")]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(list(v), t) for v, t in zip(found, types, strict=True)]], ["doc", "source", "mark", "row", "first", "last", "words", "source_first"])

    schema = f"doc {kind}, source {kind}, mark bigint, row bigint, first int, last int, words bigint, source_first int"
    return met.mapInArrow(run, schema)


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, mark, runs)``: the deleted runs of a document as an array of (first, last). Repeated rows cannot be told apart
    afterwards, so they lose what the one among them loses that loses least, nothing if the first of them loses nothing."""
    lines = hashed_lines(docs, key, text)
    runs = repeated_runs(lines).groupBy("doc", "mark", "row").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))
    least = runs.groupBy("doc", "mark").agg(F.min(F.struct(F.size("runs").alias("n"), "runs")).alias("least"), F.count("*").alias("losing"))
    rows = lines.groupBy("doc", "mark").agg(F.count("*").alias("rows"))
    return least.join(rows, ["doc", "mark"]).filter("losing = rows").select("doc", "mark", "least.runs")


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", runs: str = "removed_runs") -> DataFrame:
    """The rows with all columns and ``runs``, null where nothing is deleted; an input column of that name is replaced."""
    doc, mark = (_unused(docs, name) for name in ("doc", "mark"))
    gone = stored(removals(docs, key, text), "removals").select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("runs").alias(runs))
    here = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.drop(runs).join(gone, docs[key].eqNullSafe(gone[doc]) & (here == gone[mark]), "left").drop(doc, mark)


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_lines, removed_runs)`` of each row. Line counts meet the runs; texts stay where they are."""
    gone = stored(removals(docs, key, text), "removals")
    n_lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("bigint")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("here"), n_lines.alias("n_lines"))
    met = rows.join(gone, rows["key"].eqNullSafe(gone["doc"]) & (rows["here"] == gone["mark"]), "left")
    return met.select(F.col("key").alias(key), "n_lines", F.col("runs").alias("removed_runs"))


def _unused(docs: DataFrame, name: str) -> str:
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def line_gone(runs, k):
    return F.exists(runs, lambda r: (r["first"] <= k) & (k <= r["last"]))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all columns, later repeated runs deleted from the text; rows left without a word are dropped if
    something was deleted from them."""
    runs = _unused(docs, "removed_runs")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda _, k: ~line_gone(F.col(runs), k)), "\n")
    out = marked(docs, key, text, runs).withColumn(text, F.when(F.col(runs).isNotNull(), rest).otherwise(F.col(text)))
    return out.filter(F.col(runs).isNull() | F.rlike(text, F.lit(r"[^ \t-\r]"))).select(docs.columns)
