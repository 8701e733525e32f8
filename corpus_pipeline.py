"""Corpus pipeline: quality rules, language ID, exact dedup, near-duplicate removal, packing.

Defined cases: a null or empty text fails the quality rules; rows with a null doc_id go through all stages by their text, and their pieces carry a null
doc_id; of rows that repeat doc_id and text one stays from exact dedup on, while rows that repeat a doc_id with other texts are judged one by one;
further columns of documents, whatever their names, are carried to the last stage and ignored there; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, langid, near_dedup, packing, quality
from tidemark.llm.shared import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules and the host verdicts reject."""
    return quality.keep(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language stays unclear (posterior under one half)."""
    return langid.keep(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage returns pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("packing", packing_stage),
]

#: Language models, signatures and tokenizers have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
