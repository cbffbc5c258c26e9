"""The corpus pipeline: quality rules, language ID, SimHash near-duplicates, PII and packing, a table between each two.

Defined results of the stages: columns beyond doc_id, text and source pass through whatever their names; repeated rows
are rows of their own until the near-duplicate stage; an empty table stays empty. The stages say what they do with nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalane.llm import langid, packing, pii, quality, simhash
from stratalane.session import load, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go; a null or empty text has no words and is rejected."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no learned language explains, go; without any label all of them do."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked fingerprints stays, that of the least doc_id; without a doc_id each stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind, in whole texts of any length; a null text stays null."""
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into windows in the proportions of their sources; null text is empty, null source a queue."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("packing", pack),
]

#: No SQL says the language models, the fingerprints or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {}
