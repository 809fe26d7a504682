"""The stages of the corpus pipeline: each takes all documents that its predecessor kept.

Rows with a null id, language or text, empty texts and repeated rows are handled as the stages'
operators say: null and empty texts have no language and go in the first stage; rows without an id
keep all their lines and are never near duplicates; rows of one id stay or go together. Empty tables
pass, and so do further columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate as benchmarks
from shelfspark.llm import encode, jaccard_join, lang_id, line_dedup
from shelfspark.llm.frames import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the others teach; those too far from every language go."""
    return lang_id.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with lines kept in the first document that holds them; none goes.

    ``n_chars``, where there is such a column, is counted again.
    """
    short = line_dedup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return short
    return short.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of the least id."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return benchmarks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document in place of its text: ``ids`` and ``n_tokens``, which take the place
    of columns that are named so."""
    coded = encode.encode(docs.drop("ids", "n_tokens"), tokenizer_path())
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


#: Names and functions, in order.
STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
    ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
