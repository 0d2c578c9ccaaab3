"""Queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_snapshots, decontaminate, hard_negatives, language_id, license_scan, ngram_join, packing, pivot_search, quality_rules, substring_dedup, timestamps, token_counts, url_rules


def _read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    profiles = language_id.train(docs, ~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


def op4_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.collapse_and_render(_read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents", "doc_id", "text"), with_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words", "n_failed_lines")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_filter(_read(spark, sf_dir, "pages", "page_id", "url"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.find_contamination(docs, items)
    return found.select("doc_id", F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ",").alias("item_ids"), (F.size("item_ids") > 0).alias("contaminated"), "max_containment")


def op11_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op12_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(_read(spark, sf_dir, "stamps", "stamp_id", "source", "zone", "raw"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table, F.col("vec_id") % 50 == 0, label)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ngram_join, op3_substring_dedup, op4_chat_snapshots, op5_license_scan, op6_quality_rules, op7_url_rules, op8_packing, op9_token_counts, op10_decontaminate, op11_pivot_search, op12_timestamps, op13_hard_negatives)}
