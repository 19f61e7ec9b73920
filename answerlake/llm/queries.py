"""The queries of the text operators with their contracts' columns, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm import bpe, covertree, decontam, embeddings, extract, langid, pii, pst, sharding, simhash, toxicity, trie, warc
from answerlake.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.held_out(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.report(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


_QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_warc": op7_warc,
    "op8_main_text": op8_main_text,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_toxicity": op12_toxicity,
    "op13_conversation_trie": op13_conversation_trie,
}
_SQL = {
    "op2_embedding_dedup": embeddings.SQL,
    "op7_warc": warc.SQL,
    "op10_decontamination": decontam.SQL,
    "op11_vector_codes": covertree.SQL,
    "op13_conversation_trie": trie.SQL,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
