"""The registered queries of this subpackage, and the SQL stating their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    statement = sql.STATEMENTS.get(query.__name__)
    if statement:
        ORACLES[query.__name__] = statement
    return query


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_register
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.decontaminate import hit_report

    return hit_report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_register
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.line_dedup import dedup_report

    return dedup_report(_table(spark, folder, "documents"))


def _words_49k() -> str:
    """The tokenizer file of the token queries; the operators take any such path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_register
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.encode import code_report

    return code_report(_table(spark, folder, "documents"), _words_49k())


@_register
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.token_counts import count_report

    return count_report(_table(spark, folder, "documents"), _words_49k())


@_register
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.quality_fm import quality_report

    return quality_report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_register
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.lang_id import language_report

    return language_report(_table(spark, folder, "documents"))


@_register
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.quality_rules import rule_report

    return rule_report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_register
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.jaccard_join import near_duplicates

    return near_duplicates(_table(spark, folder, "documents"))


@_register
def op10_page_text(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.page_text import extract

    return extract(_table(spark, folder, "pages"))


@_register
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.token_files import file_report

    return file_report(_table(spark, folder, "documents"), _words_49k())


@_register
def op11_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.byte_shards import shard_report

    return shard_report(_table(spark, folder, "documents"))


@_register
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.hard_negatives import hard_negatives

    return hard_negatives(_table(spark, folder, "embeddings"))


@_register
def op13_sharded_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    from shelfspark.llm.sharded_kmeans import lloyd

    return lloyd(_table(spark, folder, "embeddings"))
