"""The registered queries: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, curve_packing, jaccard_join, lexical_tree, license_scan, line_dedup, lsh_search, negative_mining, quality_model, quality_rules, secret_scan, streaming_dedup, url_filter
from .line_dedup import line_gone
from .registry import query, table

#: The vocabulary of the queries that need one, a parameter of their operators; ``TOKENIZER_FOLDER`` names another folder.
_FOLDER = os.environ.get("TOKENIZER_FOLDER")
WORD_BPE = os.path.join(_FOLDER, "word_bpe_49k.json") if _FOLDER else public_tokenizers.path("word_bpe_49k.json")


@query("op3_quality_rules", quality_rules.judge_sql())
def op3_quality_rules(spark, folder):
    judged = quality_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_url_filters", url_filter.judge_sql())
def op8_url_filters(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "pattern", "verdict")


@query("op9_secret_scans")
def op9_secret_scans(spark, folder):
    found = secret_scan.scanned(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = secret_scan.listed(F.col("found"), secret_scan.KINDS[:3])
    return found.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("found")).alias("spans"))


@query("op10_bpe")
def op10_bpe(spark, folder):
    return bpe.encoded(table(spark, folder, "documents"), WORD_BPE)


@query("op7_packing")
def op7_packing(spark, folder):
    packed = curve_packing.packed(table(spark, folder, "documents"), WORD_BPE)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_line_dedup")
def op5_line_dedup(spark, folder):
    out = line_dedup.summaries(table(spark, folder, "documents"))
    runs = F.transform("removed_runs", lambda r: F.concat_ws("-", r["first"], r["last"]))
    gone = F.filter(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), lambda k: line_gone(F.col("removed_runs"), k))
    n_gone = F.when(F.col("removed_runs").isNull(), F.lit(0)).otherwise(F.size(gone)).cast("bigint")
    return out.select("doc_id", "n_lines", n_gone.alias("n_removed"), F.coalesce(F.array_join(runs, ","), F.lit("")).alias("removed"))


@query("op6_jaccard_join")
def op6_jaccard_join(spark, folder):
    return jaccard_join.classes(table(spark, folder, "documents"))


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark, folder):
    return lsh_search.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query("op1_quality_classifier")
def op1_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality_model.fitted(docs, table(spark, folder, "labels"), ~held_out)
    return quality_model.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_license_scans")
def op2_license_scans(spark, folder):
    return license_scan.scanned(table(spark, folder, "documents"))


@query("op11_negative_mining", negative_mining.mine_sql())
def op11_negative_mining(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negative_mining.mine(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label)


@query("op12_lexical_search", lexical_tree.search_sql())
def op12_lexical_search(spark, folder):
    return lexical_tree.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_exact_dedup", streaming_dedup.groups_sql())
def op13_exact_dedup(spark, folder):
    found = streaming_dedup.groups(spark, f"{folder}/documents.parquet")
    return found.select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
