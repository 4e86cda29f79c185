"""From raw documents to packed training sequences, one operator a stage.

Each stage works on all that its predecessor kept, is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, packing, pii, simhash, toxicity
from tidemark.llm.common import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from the labelled documents, rejects go.

    Null and empty texts stay; of repeated rows all go or all stay; without labels the fixed
    words alone decide; an empty table gives none. Columns of any name are kept.
    """
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest doc_id.

    Null ids come last, ties go by a hash of the text; of repeated rows one stays; null and
    empty texts are one component with each other; an empty table gives none. Columns of any
    name are kept.
    """
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and items hold nothing; of repeated rows all go or all stay; very long
    texts are searched whole; an empty benchmark keeps all. Columns of any name are kept.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays.

    Null texts stay null, empty and repeated rows stay; n_chars follows the text where there is
    such a column; an empty table gives none. Columns of any name are kept.
    """
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    Null text counts as empty (one end id); null ids stay null; each of repeated rows is packed;
    very long texts are cut into whole pieces; an empty table gives none. Other columns go.
    """
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the learned grammar, XXH64 fingerprints or the packing; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each result is written to the shared folder and read back."""
    docs, at = table(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
