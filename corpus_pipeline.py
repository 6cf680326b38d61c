"""From documents to packed training sequences: five stages, each on what its predecessor kept.

run() writes each stage's rows to the session's shared checkpoint folder and reads them again; what the
stages before the last wrote is removed once the next one is written.

Null and empty texts and texts of a few words are rejected by the quality rules; texts of any length are
read whole. Of repeated rows of one doc_id one stays, of equal or similar texts that of the least doc_id.
A row without doc_id that passes the rules is kept and packed under a null id. Columns besides doc_id
and text, whatever their names, are carried unread up to the last stage. Empty documents: no rows; empty
labels: nothing is toxic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import minhash, packing, pii, quality, toxicity
from lacuna.operators.graph import checkpoint_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity; what is toxic is learnt from the table's own labels."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_first(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data."""
    return pii.mask_column(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", good), ("toxicity", harmless), ("near-dedup", distinct), ("PII", private), ("packing", packed)]

#: SQL can't express the trained toxicity stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
