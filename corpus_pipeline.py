"""The corpus pipeline: from raw documents to packed training sequences.

Each stage gets the session, the documents that the stage before it kept, and the folder of the
tables. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyspark.llm.common import table
from storyspark.llm.packing import pack, word_bpe_path
from storyspark.llm.pii import mask_documents
from storyspark.llm.quality_rules import quality_rules
from storyspark.llm.simhash import keep_one_per_component
from storyspark.llm.toxicity import drop_toxic
from storyspark.plans.cutting import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or meet a learned rule go."""
    return quality_rules(docs, table(spark, sf_dir, "labels"), COLUMNS).filter("kept").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least id stays."""
    return keep_one_per_component(docs, COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; every document stays."""
    return mask_documents(docs, COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of at most 4096 tokens."""
    return pack(docs, word_bpe_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Learned models and a tokeniser are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
