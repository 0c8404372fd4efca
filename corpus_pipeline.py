"""A corpus pipeline of five stages: toxicity, quality rules, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the
documents' columns; the last returns the pieces of the packed sequences. Models are learnt from the labels
of the documents that reach the stage.

Every stage takes null ids and texts, empty and very long texts, repeated rows, empty tables and columns of any name. A
null or empty text isn't toxic, fails the base rules, is a duplicate of nothing and has no passage. Rows with a null id are
no one's duplicate; rows with equal ids are one document in near-duplicate groups and stay or go together there; ties go
to the least id. Without labels of both kinds nothing is learnt, and only fixed rules reject. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontamination, neardup, packing, quality, tokens, toxicity
from lodestar.llm.common import drop, table, written


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    return toxicity.keep(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated model."""
    return quality.keep(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return neardup.keep(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokens.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_stage),
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None
"""Learnt models and packing can't be expressed in SQL; tests/llm compares the stages with brute-force versions."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
