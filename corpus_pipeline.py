"""The training-data pipeline: each stage works on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import lines, near, packing, phrases, quality
from barloom.llm.common import Stored


# Rows that go to Python at once. Texts are long, and a batch is held on both sides, beside the heap.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
# Words that a worker remembers in packing, beside what the stages before it left in the executor (up to some 100 MB).
MEMO = 150_000


def prefer_small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size; a smaller one that the user has set is kept. A stage's plan takes it when the stage's result is written."""
    usual = int(spark.conf.get(BATCH_SETTING, "10000"))
    spark.conf.set(BATCH_SETTING, str(min(BATCH_ROWS, usual) if usual > 0 else BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    prefer_small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines, the first one stays in its document."""
    prefer_small_batches(spark)
    return lines.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents, the first one stays."""
    prefer_small_batches(spark)
    return near.keep_first(docs)


def phrase_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out."""
    prefer_small_batches(spark)
    return phrases.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the sequences."""
    prefer_small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=MEMO)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", phrase_dedup),
    ("packing", pack),
]

# Quality scores, edit distances and alignments are not SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is stored and read again, and dropped when the next one is.

    The session's batch size is lowered for the run and set back after it.
    """
    store, docs, before = Stored(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    usual = spark.conf.get(BATCH_SETTING, "10000")
    try:
        for _, stage in STAGES:
            docs = store.keep(stage(spark, docs, sf_dir))
            if before is not None:
                store.drop(before)
            before = docs
    finally:
        spark.conf.set(BATCH_SETTING, usual)
    return docs
