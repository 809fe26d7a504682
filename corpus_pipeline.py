"""Cleaning of a training corpus: language ID, line dedup, near duplicates, benchmarks, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import pipeline

STAGES = pipeline.STAGES

#: Learned language profiles, sampled signatures and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    return pipeline.run(spark, sf_dir)
