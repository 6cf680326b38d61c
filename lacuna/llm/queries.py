"""The training-data queries: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import align, bpe, chat, collocations, embed_dedup, lang_id, license_scan, minhash, packing, pii, quality, suffix_dedup, toxicity
from lacuna.llm._text import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return lang_id.identify(docs, lang_id.fit(docs))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(documents(spark, sf_dir, "doc_id", "text"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir, "doc_id", "text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir, "doc_id", "text"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(documents(spark, sf_dir, "doc_id", "text"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir, "doc_id", "text"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(documents(spark, sf_dir, "doc_id", "text"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir, "text", "lang"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_minhash, op3_license_scan, op4_chat_formatting, op5_embedding_dedup, op6_toxicity, op7_quality_rules, op8_best_fit_packing, op9_pii_surrogates, op10_byte_bpe, op11_suffix_dedup, op12_token_alignment, op13_collocations)}
ORACLES = {"op2_minhash": minhash.ORACLE, "op4_chat_formatting": chat.ORACLE, "op5_embedding_dedup": embed_dedup.ORACLE, "op7_quality_rules": quality.ORACLE}
