"""The corpus pipeline: toxic, unidentified, duplicated and contaminated documents go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns of
``documents``. ``run`` applies them to the documents, each stage written as Parquet in the shared folder and read again,
so a lost executor costs one stage at most. Null and empty texts: toxicity scores them like any text without
hits, language ID rejects them (they have no letters). Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stripweave.llm import decontam, langid, neardup, pieces, toxicity
from stripweave.llm.common import read, saved


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; lexicon and weights are learned from these documents and their labels."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a span in a learned language, go; where none was learned, texts with letters stay."""
    return langid.keep_known(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; links from similarity 0.8 on, bands sized for it."""
    return neardup.drop_near_duplicates(docs, percent=80, bands=48, rows=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty inside a benchmark window go."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, piece ids, their number, and whether they decode to the text."""
    return pieces.encode_report(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: A learned classifier and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
