"""A corpus pipeline: language ID, toxicity, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All stages but the last
return the columns of documents, so that their decisions are the rows that stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, language_id, packing, simhash_dedup, toxicity
from gridloom.llm.common import shared_folder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: those that the classifier rejects, null texts and texts without a letter."""
    return language_id.keep_identified(docs)


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted as toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of equal texts."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each SimHash component."""
    return simhash_dedup.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences, one row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", filter_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    folder = shared_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{at}-{name}")
            docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the learned filters nor fingerprints and packing.
ORACLE_SQL = None
