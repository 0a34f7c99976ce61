"""A training corpus from raw documents: classify, deduplicate, near-deduplicate, decontaminate, tokenize.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written as
Parquet before the next one reads it. All but the last return the columns of ``documents``. Stages with Python code set a bound on
the session's Arrow batches (``small_batches``), which holds for what they return, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import decontaminate, exact_dedup, quality, queries, simhash, tiktoken_codec
from seamline.llm.common import discard, small_batches, written

#: Documents that score lower go.
QUALITY_THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the nearest-neighbour vote rejects."""
    small_batches(spark)
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, QUALITY_THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of equal texts."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of documents that share 0.8 or more of their five-word shingles."""
    small_batches(spark)
    return simhash.keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain 0.8 or more of a benchmark item's five-word shingles."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, queries.table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    small_batches(spark)
    return tiktoken_codec.round_trip(docs, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern(), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", token_stage),
]

#: Scores, fingerprints and token ids have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            if k:
                discard(before)
    return docs
