"""Hard negatives, ranked search and streaming dedup against brute force in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import common, lexical_tree, negative_mining, streaming_dedup

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, share int, tops string, n int"


def mined_by_hand(rows, every):
    good = {}
    for vec_id, v, label in rows:
        if label is None or v is None or vec_id is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-(1 << 63), min((1 << 63) - 1, math.floor(float(np.float32(x)) * 256))) for x in v]
        good[(vec_id, label, tuple(whole))] = (vec_id, label, whole)
    out = []
    for a_id in sorted({r[0] for r in good.values() if r[0] % every == 0}):
        _, a_label, a = min((r for r in good.values() if r[0] == a_id), key=lambda r: (r[1], r[2]))
        scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, v)))), i, lab) for i, lab, v in good.values() if len(v) == len(a)]
        positives = sorted((s, i) for s, i, lab in scored if lab == a_label and i != a_id)[: negative_mining.POSITIVES]
        for ps, p in positives:
            fits = sorted((s, i) for s, i, lab in scored if lab != a_label and 30 * -ps <= 100 * -s <= 90 * -ps)[: negative_mining.NEGATIVES]
            out += [(a_id, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fits)]
    return sorted(out)


def vectors(rnd, n, size):
    rows = [(i, [rnd.uniform(-1, 1) + (i % 3) * 0.4 for _ in range(size)], rnd.randint(0, 3)) for i in range(n)]
    same = rows[4][1]
    rows += [(n + i, same, i % 2) for i in range(60)]  # one vector many times: ties
    odd = [(900, None, 1), (905, [float("nan")] * size, 1), (910, [1.0, None] + [0.5] * (size - 2), 1), (915, [float("inf")] * size, 0), (920, [0.0] * size, 1),
           (925, [], 0), (930, [0.5] * (size - 1), 0), (935, [0.25] * (size - 1), 1), (940, [0.5] * size, None), (945, [3e15] * size, 2), (950, [2e15] * size, 1), (0, same, 1), (0, same, 1)]
    return rows + odd


def test_hard_negatives(spark):
    rows = vectors(random.Random(5), 300, 6)
    df = spark.createDataFrame([(i, v, label, "x", 1, "t", 2) for i, v, label in rows], VECTORS).repartition(5)
    got = sorted(tuple(r) for r in negative_mining.mine(df, F.col("id") % 5 == 0).collect())
    assert got == mined_by_hand(rows, 5)
    assert negative_mining.mine(df.limit(0), F.col("id") % 5 == 0).count() == 0


def test_hard_negatives_when_a_task_sends_early(spark, monkeypatch):
    monkeypatch.setattr(negative_mining, "PACK", 16)
    rows = vectors(random.Random(6), 120, 4)
    held = negative_mining._Held(3)
    for k in range(5):
        held.add(np.array([1, 1, 2], dtype=np.int64), 0, np.array([k, 9, -k], dtype=np.int64), np.array([k, 7, k], dtype=np.int64))
    assert [x.tolist() for x in held.best()] == [[1, 1, 1, 2, 2, 2], [0] * 6, [9, 9, 9, 0, -1, -2], [7, 7, 7, 0, 1, 2]]
    df = spark.createDataFrame([(i, v, label, "x", 1, "t", 2) for i, v, label in rows], VECTORS).repartition(3)
    assert sorted(tuple(r) for r in negative_mining.mine(df, F.col("id") % 5 == 0).collect()) == mined_by_hand(rows, 5)


def test_keys_sort_as_their_parts():
    rnd = random.Random(1)
    extremes = [-(1 << 63), -1, 0, 1, (1 << 63) - 1]
    parts = [(rnd.choice(extremes), rnd.choice(extremes), rnd.randint(0, 1), rnd.choice(extremes)) for _ in range(200)]
    assert [negative_mining.unpacked(negative_mining.packed_key(*p)) for p in parts] == parts
    by_key = sorted(parts, key=lambda p: negative_mining.packed_key(*p))
    assert by_key == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))
    columns = [np.array(c, dtype=np.int64) for c in zip(*[p for p in parts if p[2] == 1])]
    keys = negative_mining._keys(columns[0], columns[1], 1, columns[3]).to_pylist()
    assert keys == [negative_mining.packed_key(*p) for p in parts if p[2] == 1]


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_by_hand(docs, items, k):
    bags = [(i, terms_of(t)) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            if i is None or not bag:
                continue
            tf, m = Counter(bag), 75 + 25 * len(bag) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms_of(text))
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


LETTERS = "a b c d e f g h river stone Bridge market ü ß42 x1".split()


def corpus(rnd):
    docs = [(i, " ".join(rnd.choices(LETTERS, k=rnd.randint(0, 30)))) for i in range(260)]
    docs += [(1000 + i, "river stone, river market") for i in range(150)]  # copies: one path of the tree, ties
    docs += [(2000 + i, " ".join(LETTERS[: i % len(LETTERS)])) for i in range(120)]  # each path a part of the next
    return docs + [(3000, None), (3001, ""), (3002, " \n-- "), (None, "river a"), (7, "a second row, river"), (3003, "stone " * 20_000 + "y" * 5000), (3004, "y" * 5000)]


@pytest.mark.parametrize("leaf", [2, 64])
def test_ranked_search(spark, monkeypatch, leaf):
    rnd = random.Random(3)
    docs = corpus(rnd)
    items = [(i, " ".join(rnd.choices(LETTERS, k=6))) for i in range(12)] + [(50, None), (51, "nothing known"), (52, "river RIVER stone"), (52, "b"), (None, "market"), (53, "y" * 5000)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, n int, id int").repartition(4)
    asked = spark.createDataFrame([(i, t, "r") for i, t in items], "item_id bigint, text string, rank string").repartition(2)
    monkeypatch.setattr(lexical_tree, "BLOCK_ITEMS", 7)  # several passes
    monkeypatch.setattr(lexical_tree, "LEAF", leaf)
    got = sorted((tuple(r) for r in lexical_tree.search(frame, asked, k=9).collect()), key=str)
    assert got == ranked_by_hand(docs, items, 9)
    assert lexical_tree.search(frame.limit(0), asked).count() == 0 and lexical_tree.search(frame, asked.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_trees_skip_nothing(monkeypatch, leaf):
    """One tree against scoring every document, with few leaves and many."""
    monkeypatch.setattr(lexical_tree, "LEAF", leaf)
    rnd = np.random.default_rng(leaf)
    bags = [np.unique(rnd.zipf(1.3, rnd.integers(1, 40)) % 50) for _ in range(700)] + [np.arange(1, 1 + k % 30) for k in range(1, 90) if k % 30]
    sizes = np.array([len(b) for b in bags])
    ranks, ids = np.concatenate(bags), rnd.permutation(len(bags)).astype(np.int64)
    tfs, m = rnd.integers(1, 6, len(ranks)), rnd.integers(75, 200, len(bags))
    tree = lexical_tree.Tree(ids, m, sizes, ranks, tfs)
    cuts = np.append(0, np.cumsum(sizes))
    for _ in range(60):
        terms = np.unique(rnd.integers(0, 50, 6))
        gains = rnd.integers(0, 900, len(terms))
        gain = dict(zip(terms.tolist(), gains.tolist()))
        want = []
        for d in range(len(bags)):
            score = sum(gain.get(int(r), 0) * (1_000_000_000 * int(t) // (1000 * int(t) + 12 * int(m[d]))) for r, t in zip(ranks[cuts[d] : cuts[d + 1]], tfs[cuts[d] : cuts[d + 1]]))
            want.append((-score, int(ids[d])))
        best = lexical_tree.Best(11)
        tree.search(terms, gains, best)
        want = [w for w in sorted(want) if w[0] < 0][:11]
        assert list(zip((-best.score).tolist(), best.ids.tolist())) == want


DOCUMENTS = "doc_id bigint, text string, lang string, n bigint, digest string, file int, _metadata string"
TEXTS = [None, "", "A b", "a B", "a b ", "ä", "Ä", "long " * 200_000, "LONG " * 200_000, "x\ny", "same"] + ["same"] * 40


def grouped_by_hand(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = Counter()
    for members in groups.values():
        known = [i for i in members if i is not None]
        for i in members:
            out[(i, max(known) if known else None, len(members))] += 1
    return out, len(groups)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, tmp_path, weak):
    """The weak digest has two values, so that different texts meet under one: only their bytes tell them apart."""
    rows = [(i * 3 % 101, t) for i, t in enumerate(TEXTS)] + [(None, "A b"), (None, "null id only"), (500, "twice"), (500, "twice")]
    spark.createDataFrame([(i, t, "en", 1, "d", 2, "m") for i, t in rows], DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/docs")
    digest = (lambda t: F.unhex(F.hex(F.crc32(t) % 2))) if weak else streaming_dedup.sha
    found = streaming_dedup.groups(spark, f"{tmp_path}/docs", digest=digest).collect()
    want, n_groups = grouped_by_hand(rows)
    assert Counter((r.key, r.keep_id, r.group_size) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == n_groups and all(r.key == r.keep_id for r in kept)
    if not weak:
        stay = streaming_dedup.survivors(spark, f"{tmp_path}/docs")
        assert stay.columns == DOCUMENTS.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ") and stay.count() == n_groups


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    folder, state = f"{tmp_path}/docs", f"{tmp_path}/state"
    write = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(folder)
    write([(1, "a"), (2, "b")])
    assert {(r.keep, r.n) for r in streaming_dedup.state_of(spark, folder, state=state).collect()} == {(1, 1), (2, 1)}
    write([(3, "A"), (4, "c")])
    found = streaming_dedup.groups(spark, folder, state=state).collect()
    assert {(r.key, r.keep_id, r.group_size, r.kept) for r in found} == {(1, 3, 2, False), (3, 3, 2, True), (2, 2, 1, True), (4, 4, 1, True)}


def test_exact_dedup_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none")
    assert streaming_dedup.groups(spark, f"{tmp_path}/none").count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


def test_regular_spans_do_not_collide():
    words = [*thue_morse(1024), *thue_morse(2048), "a" * 1024, "a" * 1032, "a" * 1023, "", "a", "a\0", "\0", "\0\0", "ab" * 512, "ba" * 512]
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    end = np.cumsum([len(w) for w in words])
    for seed in (0, 1):
        found = common.hashes(data, end - [len(w) for w in words], end, seed)
        assert len(set(found.tolist())) == len(words)
    assert (common.hashes(data, end - [len(w) for w in words], end) != common.hashes(data, end - [len(w) for w in words], end, 1)).all()
    # The same span hashes the same wherever it lies.
    moved = np.frombuffer(b"xyz" + words[0].encode(), dtype=np.uint8)
    assert common.hashes(moved, np.array([3]), np.array([1027]))[0] == common.hashes(data, np.array([0]), np.array([1024]))[0]
