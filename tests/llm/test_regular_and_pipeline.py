"""Words that regular hashes confuse, and the stages of the corpus pipeline."""

import os
import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from ledgerlake.llm import bpe, curve_packing, jaccard_join, license_scan, line_dedup, quality_rules, secret_scan
from ledgerlake.llm.queries import WORD_BPE

needs_vocabulary = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="the public tokenizer is not here")
FIRST = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
SECOND = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
WORDS = "the of and to in that river stone bridge market winter garden letter silver tower doctor music paper engine window harbour is was for it with as on".split()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def test_two_regular_words_are_not_one(spark):
    # Documents that share all words but one of the two: no shingle in common.
    found = {r.doc_id: r.component_id for r in jaccard_join.classes(frame(spark, [f"river {FIRST} stone", f"river {SECOND} stone", f"river {FIRST} stone"])).collect()}
    assert found == {0: 0, 1: 1, 2: 0}
    # Lines of them, and lines of two words in that order.
    rnd = random.Random(2)
    pair = [" ".join(FIRST).replace("a", "stone").replace("b", "river"), " ".join(SECOND).replace("a", "stone").replace("b", "river")]
    texts = [f"{FIRST}\n{pair[0]}", f"{SECOND}\n{pair[1]}", "\n".join(rnd.choices(WORDS, k=3)), f"{FIRST}\n{pair[0]}"]
    gone = {r.doc_id: r.removed_runs for r in line_dedup.summaries(frame(spark, texts)).collect()}
    assert gone[0] is None and gone[1] is None and gone[3] is not None
    template = " ".join([*WORDS, FIRST, *WORDS])
    hits = license_scan.scanned(frame(spark, [template, template.replace(FIRST, SECOND), "short"]), templates=[("regular", template)])
    shares = {r[0] for r in hits.collect()}
    assert 0 in shares


@needs_vocabulary
def test_two_regular_words_keep_their_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    texts = [FIRST, SECOND, f"{SECOND} {FIRST}", f"x {FIRST}y"]
    got = {r.doc_id: r.n_tokens for r in bpe.encoded(frame(spark, texts), WORD_BPE).collect()}
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == {i: len(x) for i, x in enumerate(ids)} and ids[0] != ids[1]
    pieces = curve_packing.packed(frame(spark, texts), WORD_BPE).collect()
    for i, x in enumerate(ids):
        mine = b"".join(p.ids for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start))
        assert mine == b"".join(t.to_bytes(4, "little") for t in [*x, 2])


def texts_of_all_kinds():
    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice(WORDS) + (str(rnd.randint(0, 999)) if rnd.random() < 0.5 else "") for _ in range(n))
    passage = "\n".join(prose(12) for _ in range(6))
    base = prose(200)
    near = base.split()
    near[100] = "changed"
    return [None, "", "too short", base, " ".join(near), base, *(prose(150) for _ in range(12)), f"{prose(80)}\n{passage}\n{prose(70)}", f"{prose(60)}\n{passage}\n{prose(90)}",
            f"{prose(120)} password = hunter2hunter", "a b c " * 100]


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "secret scans", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@needs_vocabulary
def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    texts = texts_of_all_kinds()
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, str(tmp_path))
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        after[name] = rows
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text or "") for r in rows if r.doc_id not in (0,)) or name in ("quality rules", "n-gram Jaccard join")
        if name == "quality rules":
            kept = {r.doc_id for r in quality_rules.judge(before).collect() if r.kept}
            assert {r.doc_id for r in rows} == kept and not kept & {0, 1, 2, len(texts) - 1}
            assert {r.doc_id: r.text for r in rows} == {i: texts[i] for i in kept}
        elif name == "line dedup":
            # The passage stays once, whole lines of it; all else stays as it is.
            lines = Counter(line for r in rows for line in r.text.split("\n") if len(line.split()) == 12)
            assert len(lines) == 6 and set(lines.values()) == {1}
            assert 5 not in {r.doc_id for r in rows}  # of equal documents the later is one repeated run
        elif name == "n-gram Jaccard join":
            sets = {r.doc_id: {tuple(r.text.split()[k : k + 5]) for k in range(len(r.text.split()) - 4)} for r in before.collect()}
            near = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
            assert near and {r.doc_id for r in rows} == set(sets) - near
        elif name == "secret scans":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
            assert not any("hunter2hunter" in r.text for r in rows) and not any(secret_scan.scan(r.text) for r in rows)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    final = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in after["secret scans"]}
    taken = {}
    for p in after["packing"]:
        ids = final[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(final[p.doc_id]) and p.ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids))
        taken.setdefault(p.doc_id, []).append((p.start, p.length))
    assert {i: sum(n for _, n in v) for i, v in taken.items()} == {i: len(x) for i, x in final.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    shown = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert {r[0] for r in shown(whole)} == set(final) and sum(r.length for r in whole) == sum(map(len, final.values()))


def test_stages_of_nothing(spark):
    docs = frame(spark, ["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0


def test_line_dedup_keeps_clashing_columns(spark):
    run = "\n".join(" ".join(WORDS[k : k + 10]) for k in range(6))
    rows = [(1, run, "a", 5, True), (2, f"{run}\nlast line stays", "b", 6, False), (3, None, "c", 7, True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _doc string, _mark int, removed_runs boolean")
    out = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    assert docs.columns == line_dedup.deduplicated(docs).columns
    assert out[1].text == run and out[2].text == "last line stays" and out[3].text is None
    assert [tuple(out[i])[2:] for i in (1, 2, 3)] == [r[2:] for r in rows]
