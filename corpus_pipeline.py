"""The corpus pipeline: quality filter, near-duplicate removal, redaction, packing.

Each stage works on all that its predecessor kept; what it returns is written as
Parquet to the folder that the cluster shares and read again by the next one.  The
last returns sequences that hold the token ids of the redacted texts, so nothing of
the earlier tables is needed to use them.

Defined results: the quality stage drops null, empty and blank texts, and with them
nothing is left for later stages to define; rows without ``doc_id`` stay, as copies of
nothing; of repeated rows of one ``doc_id`` one stays; texts of any length are worked on
whole; of equal texts that with the least ``doc_id`` stays; an empty table gives no
sequences, as do labels of one class no rejections.  Other columns pass through all stages but
the last whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fringeworks.llm import packing, pii, quality, simhash
from fringeworks.llm.workspace import Workspace, documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, accepts."""
    return quality.stage(spark, docs, sf_dir)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.stage(spark, docs, sf_dir)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and secrets replaced."""
    return pii.stage(spark, docs, sf_dir)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, and which piece of which document begins where in them."""
    return packing.stage(spark, docs, sf_dir)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

# a fitted model, connected components and packing rounds aren't expressible in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of ``sf_dir``."""
    ws = Workspace(spark, "pipeline")
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
        ws.drop(before)
        before = docs
    return docs
