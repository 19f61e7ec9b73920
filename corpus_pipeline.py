"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last keep the
columns of documents, extra ones included. `run` writes every stage's result to the shared folder and reads it again.

Null texts and texts without letters go with the first stage. Of repeated rows and of equal or nearly equal texts one
row stays (smallest doc_id, null ids last). Empty tables give empty results. Texts are taken whole; Arrow
batches are bounded by bytes (`BATCH_BYTES`), so that long texts make batches of fewer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerlake.llm import bpe, decontam, langid, pii, simhash
from answerlake.llm.common import table
from answerlake.session import hand_over

#: Bytes of an Arrow batch between Spark and Python; a longer single text is a batch of its own.
BATCH_BYTES = "8m"
#: Bytes of text that a task of the last stage puts together at a time; a longer single text is one chunk.
CHUNK_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """A batch is held several times at both sides, so its size decides the memory of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language model accepts: no letters, or characters no language explains."""
    bounded(spark)
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id."""
    bounded(spark)
    return simhash.keep_first(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of test items out of texts; mostly copied documents go."""
    bounded(spark)
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces emails, addresses, card and phone numbers by the names of their kinds."""
    bounded(spark)
    return pii.mask(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of the text they decode to."""
    bounded(spark)
    return bpe.tokenised(docs, CHUNK_BYTES)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("personal_data", mask_personal_data),
    ("tokens", encode_tokens),
]

#: Fingerprints, models and merges have no SQL form; tests compare the rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = hand_over(stage(spark, docs, sf_dir), name)
    return docs
