"""Corpus cleaning pipeline over ``documents``.

Stages, in order: quality rules, n-gram Jaccard join, substring dedup,
benchmark decontamination, packing.  Each stage's result is written as Parquet
and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from insightloom.llm import common, decontaminate, ngram_join, packing, quality_rules, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines that fail a rule are removed, documents that lose too
    much text go; n_chars follows the text.  Null and empty texts are rejected."""
    return quality_rules.clean_documents(_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of linked documents the one with the smallest
    doc_id stays; of rows with one doc_id in a group, the first by text.
    Documents without words, linked with nothing, all stay."""
    return ngram_join.keep_one(_columns(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: repeated 13-word windows are cut from all but their first
    document; n_chars follows the text.  A fully cut document stays, empty."""
    return substring_dedup.cut_documents(_columns(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.keep_clean(_columns(docs), items)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of the packed sequences."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", repeats),
    ("benchmark decontamination", benchmark),
    ("packing", pack),
]

#: Worker-wise packing and tokenizer ids have no SQL form; the
#: stages are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs, "stage")
    return docs
