"""License scans: windows of a text retrieve templates by MinHash bands, and shingle containment confirms them.

Texts and templates are lower-cased and cut into runs of letters and digits; their five-word shingles are hashed. For every size
class of templates, windows of a power of two of shingles slide over the whole text with an overlap in which a template
fits. Each of ``BANDS`` MinHash values of a window is a band of its own: a window that holds three quarters of a template's shingles
and is at most three times as long has a similarity of 0.23 at least, and meets it in some band with a probability over
0.9997. The shingles around such a window are then compared with the template's exactly.

Templates are an argument and go to the tasks with the code; nothing is shuffled.

Defined cases: null and empty texts, and texts of fewer than five words, match nothing; overlapping matches of one template are one;
repeated rows are scanned alike; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grams, hashes, mixed, slices, spans, utf8

#: Public license notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

WIDTH, SHARE, BANDS = 5, 75, 32

_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _PLAIN[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _PLAIN[_c] = _c + 32
_SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every five-word shingle, in order."""
    offsets, data = utf8(column)
    data = _PLAIN[data]
    text, begin, end = spans(offsets, data)
    return grams(text, hashes(data, begin, end), WIDTH)


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        owner, value = _shingles(pa.array([t for _, t in templates], pa.string()))
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(value[owner == k]) for k in range(len(templates))]
        self.classes: dict[int, list[int]] = {}
        for k, one in enumerate(self.sets):
            if not len(one):
                raise ValueError(f"a template without words: {self.names[k]}")
            self.classes.setdefault(1 << int(np.ceil(np.log2(max(1.5 * len(one), 1)))), []).append(k)

    def scan(self, owner: np.ndarray, value: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first and last shingle in the text, containment) of all confirmed matches."""
        if not len(value):
            return []
        start_of = np.searchsorted(owner, owner)
        near: set[tuple[int, int, int]] = set()
        for seed in _SEEDS:
            low, width = mixed(value ^ seed), 1
            for size in sorted(self.classes):
                while width < size:
                    if width < len(low):  # a window that reaches the end holds all that follows
                        low[: len(low) - width] = np.minimum(low[: len(low) - width], low[width:])
                    width *= 2
                shortest = min(len(self.sets[k]) for k in self.classes[size])
                longest = max(len(self.sets[k]) for k in self.classes[size])
                step = max(1, min(size - longest + 1, shortest, size // 4))
                windows = np.arange(0, len(value), step)
                mins = low[windows]
                for k in self.classes[size]:
                    want = mixed(self.sets[k] ^ seed).min()
                    near |= {(int(w), size, k) for w in windows[mins == want]}
        found: dict[tuple[int, int], list[list]] = {}
        for w, size, k in sorted(near, key=lambda c: (c[2], c[0])):
            one = self.sets[k]
            lo, hi = max(0, w - len(one)), min(len(value), w + size + len(one))
            hits = lo + np.flatnonzero(np.isin(value[lo:hi], one))
            for text in np.unique(owner[hits]).tolist():
                own = hits[owner[hits] == text]
                part = len(np.unique(value[own])) / len(one)
                if 100 * part >= SHARE:
                    a, b = int(own[0] - start_of[own[0]]), int(own[-1] - start_of[own[0]])
                    matches = found.setdefault((text, k), [])
                    if matches and a <= matches[-1][1]:
                        matches[-1] = [min(a, matches[-1][0]), max(b, matches[-1][1]), max(part, matches[-1][2])]
                    else:
                        matches.append([a, b, part])
        return [(text, k, a, b, part) for (text, k), matches in sorted(found.items()) for a, b, part in matches]


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``(key, license, template, first_word, last_word, containment)`` of each match; words count from 0."""
    kind = next(f for f in docs.schema.fields if f.name == key).dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for whole in batches:
            for batch in slices(whole, 1):
                found = known.scan(*_shingles(batch.column(1)))
                texts, which, first, last, part = zip(*found, strict=True) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(texts, pa.int64())), pa.array([known.names[k] for k in which], pa.string()), pa.array(which, pa.int32()),
                    pa.array(first, pa.int64()), pa.array([b + WIDTH - 1 for b in last], pa.int64()), pa.array(part, pa.float64()),
                ], ["key", "license", "template", "first_word", "last_word", "containment"])

    schema = f"key {kind}, license string, template int, first_word bigint, last_word bigint, containment double"
    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, schema).withColumnRenamed("key", key)
