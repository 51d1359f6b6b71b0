"""A corpus pipeline of five stages: each takes what its predecessor kept and returns what it keeps.

quality classifier, near-duplicates, benchmark decontamination, personal data, mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamworks.llm import decontam, mixing, neardup, pii, quality
from loamworks.session import Workspace, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine doesn't reject."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, Jaccard from 0.8."""
    return neardup.deduplicate(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked, n_chars to match."""
    return pii.redact(docs, length="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, with mix_pass."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Training, components and the span classifier are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    work, docs = Workspace(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
