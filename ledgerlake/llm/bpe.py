"""Byte-pair encoding and decoding with an index from pairs to their positions.

The words of a batch that are not known yet are laid out as one array of symbols. An index maps each adjacent pair, by
the rank of its merge, to all its positions. Active ranks are applied in ascending order, each to all its positions at once;
the pairs that come to be next to a merged position are entered under their own ranks. Words are independent of each
other, so this gives every word what merging it alone by lowest rank would give.

The tokenizer file is read on the driver and sent to the tasks (about 2 MB whatever the input); nothing is shuffled.

Defined cases: a null text is empty and has no ids; the strings of special tokens inside a text become their ids, as the
tokenizers library does; texts with characters outside the blocks whose case and letter rules are checked here are normalised
and split by the library, whose tables may be of another Unicode version; repeated rows are encoded alike."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes, slices, spans, utf8

#: Words kept from one batch to the next.
MOST_WORDS = 600_000
#: Bytes of text whose new words are merged together.
BATCH_BYTES = 16 << 20

#: How this tokenizer splits text. White space only separates, so words between white space are split alone.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin, Greek, Cyrillic and general punctuation are normalised and split here; words with anything else by the library.
OTHER = re.compile("[\x1c-\x1f԰-᷿⁰-￿\U00010000-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is a visible Latin-1 character, else the next free
    one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


class _Numbers(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    def __init__(self, source: str):
        self.source, spec = source, json.loads(source)
        model = spec["model"]
        vocab, ending = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + ending] for c in letters], dtype=np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        by_id = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.token = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.library = None
        self.forget()

    def forget(self) -> None:
        """Words known by their hash, in order, and the ids of all of them in one array."""
        self.known, self.slot = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.flat, self.start, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, -1 where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (of one byte at least), and how many each has."""
        ends = np.cumsum([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1], before[np.concatenate([[0], ends[:-1]])] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            found = self.ranks(symbol[places], symbol[after[places]])
            has = found >= 0
            places, found = places[has], found[has]
            if not len(places):
                return
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(found)]
            for rank, a, b in zip(found[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(places[a:b])

        enter(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[rank], self.right[rank]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # a run of equal symbols is paired from its left end
                used, free = set(), []
                for p in at.tolist():
                    if p not in used:
                        free.append(p)
                        used.add(int(after[p]))
                at = np.array(free, dtype=np.int64)
            if not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            symbol[at], symbol[gone], after[at] = self.made[rank], -1, behind
            follows = behind >= 0
            before[behind[follows]] = at[follows]
            ahead = before[at]
            enter(np.concatenate([ahead[ahead >= 0], at[follows]]))
        alive = symbol >= 0
        counts = np.add.reduceat(alive.astype(np.int64), np.concatenate([[0], ends[:-1]]))
        return symbol[alive].astype(np.uint32), counts

    def pieces(self, word: str) -> list[str]:
        """What the library makes of one word between white space: pieces, and special tokens as they are."""
        if word.isascii() and (word.isalpha() or word[:-1].isalpha() and word[-1] in ".,"):
            word = word.lower()
            return [word] if word.isalpha() else [word[:-1], word[-1]]
        if "<" in word and self.specials and self.specials.search(word):
            return [p for part in self.specials.split(word) for p in ([part] if part in self.special else self.pieces(part) if part else [])]
        if OTHER.search(word):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.source)
                self.unletter = {c: b for b, c in enumerate(byte_letters())}
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
            return [bytes(self.unletter[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in split]
        return SPLIT.findall(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower())

    def _learn(self, words: list[str]) -> None:
        """Appends the ids of new words; pieces that several of them have are merged once."""
        unique, each, counts = _Numbers(), [], []
        number = unique.__getitem__
        for w in words:
            found = self.pieces(w)
            counts.append(len(found))
            each += map(number, found)
        special = np.array([w in self.special for w in unique], dtype=bool)
        plain = [w.encode("utf-8", "surrogateescape") for w in unique if w not in self.special]
        ids, some = self.merged(plain) if plain else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        sizes, begin = np.ones(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=np.int64)
        sizes[~special], begin[~special] = some, np.cumsum(some) - some
        begin[special] = len(ids) + np.arange(special.sum())  # a special token has one id, behind the others
        ids = np.concatenate([ids, np.array([self.special[w] for w in unique if w in self.special], dtype=np.uint32)])
        each, owner = np.array(each, dtype=np.int64), np.repeat(np.arange(len(words)), counts)
        total = np.bincount(owner, weights=sizes[each], minlength=len(words)).astype(np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(total) - total])
        self.sizes = np.concatenate([self.sizes, total])
        self.flat = np.concatenate([self.flat, taken(ids, begin[each], sizes[each])])

    def encode(self, batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a batch, one text after another, and how many each has."""
        if len(self.known) > MOST_WORDS:
            self.forget()
        owners, words, base = [], [], 0
        pending, fresh = np.zeros(0, dtype=np.uint64), ([], [])
        for part in slices(batch, column):
            offsets, data = utf8(part.column(column))
            text, begin, end = spans(offsets, data)
            word = hashes(data, begin, end)
            codes, unique = pd.factorize(word)
            new = np.flatnonzero(~_has(self.known, unique) & ~_has(pending, unique))
            if len(new):
                first = np.zeros(len(unique), dtype=np.int64)
                first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                raw, at = data.tobytes(), first[new]
                fresh[0].append(unique[new])
                fresh[1].extend(raw[b:e].decode() for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True))
                pending = np.sort(np.concatenate([pending, unique[new]]))
            owners.append(text + base)
            words.append(word)
            base += part.num_rows
        if fresh[1]:
            count = len(self.sizes)
            self._learn(fresh[1])
            known = np.concatenate([self.known, *fresh[0]])
            slot = np.concatenate([self.slot, np.arange(count, len(self.sizes))])
            order = np.argsort(known)
            self.known, self.slot = known[order], slot[order]
        if not words or not sum(map(len, words)):
            return np.zeros(0, dtype=np.uint32), np.zeros(batch.num_rows, dtype=np.int64)
        codes, unique = pd.factorize(np.concatenate(words))
        slot = self.slot[np.searchsorted(self.known, unique)][codes]
        size = self.sizes[slot]
        counts = np.bincount(np.concatenate(owners), weights=size, minlength=batch.num_rows).astype(np.int64)
        return taken(self.flat, self.start[slot], size), counts

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces, as the library does for a tokenizer without a decoder."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


def _has(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def taken(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after another."""
    if not len(start):
        return values[:0]
    end = np.cumsum(size)
    return values[np.arange(end[-1]) + np.repeat(start - end + size, size)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """One encoder for each file and worker."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(source)
    return _ENCODERS[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and, of each row, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by spaces) and ``decoded_sha256``."""
    source = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    kind = next(f for f in docs.schema.fields if f.name == key).dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(source.value)
        number = [str(k) for k in range(len(model.token))].__getitem__
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                ids, counts = model.encode(batch, 1)
                digests, decoded = [], []
                for one in np.split(ids, np.cumsum(counts)[:-1]):
                    digests.append(hashlib.sha256(" ".join(map(number, one.tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(model.decode(one).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, schema).withColumnRenamed("key", key)
