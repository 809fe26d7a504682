"""Readers: merchant CSV feeds, enrichment lines, event logs, golden sets, settings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.schema import LOG_EVENT

MERCHANT_DEFAULTS = {"rerank_enabled": False, "alpha_override": None, "default_currency": None}


def read_feed(spark: SparkSession, paths: str | Sequence[str], tenant: str | None = None,
              multi_line: bool = False) -> DataFrame:
    """All columns as text plus feed_seq, in file order and then row order.

    Each file is its own scan, so the order of the list holds whatever the sizes are.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    scans = [
        spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
        .withColumn("file_idx", F.lit(i)) for i, path in enumerate(files)]
    feed = union_feeds(scans).withColumn("feed_seq", F.monotonically_increasing_id())
    return feed if tenant is None else feed.withColumn("tenant", F.lit(tenant))


def widen(rows: DataFrame) -> DataFrame:
    """Spread a scan with fewer partitions than cores (a few small files) before costly
    per-row work; a scan that already fills the cluster is left alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    have = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows.repartition(cores) if have < cores else rows


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """Rows of all feeds; a column missing from one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def latest_labels(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """key -> label from lines of ``classifications`` maps; a later line wins."""
    entries = lines.select(*order, F.explode("classifications").alias("key", "label"))
    return entries.groupBy("key").agg(F.max_by("label", F.struct(*order)).alias("label"))


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """Labels from JSON-lines files, read in the order of their names; a missing path gives none."""
    schema = T.StructType([T.StructField(
        "classifications", T.MapType(T.StringType(), T.StringType()))])
    try:
        lines = spark.read.schema(schema).json(path).select(
            "classifications", F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        lines = spark.createDataFrame([], schema).withColumns({"file": F.lit(""), "block": F.lit(0)})
    return latest_labels(lines.withColumn("line", F.monotonically_increasing_id()),
                         ["file", "block", "line"])


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Structured events from JSON text; lines that are no JSON are dropped."""
    parsed = lines.withColumn("_e", F.from_json(column, LOG_EVENT))
    return parsed.where(F.col("_e.event").isNotNull()).select(
        *[c for c in lines.columns if c != column], "_e.*")


def explode_judgments(golden: DataFrame) -> DataFrame:
    """Golden queries with judgments map<sku,int> as (qid, tenant, sku, rel) rows."""
    return golden.select("qid", "tenant", F.explode("judgments").alias("sku", "rel"))


def with_settings(rows: DataFrame, merchants: DataFrame) -> DataFrame:
    """Rows with their merchant's settings; an unknown merchant gets the defaults."""
    joined = rows.join(merchants, "tenant", "left")
    for name, default in MERCHANT_DEFAULTS.items():
        if name in merchants.columns and default is not None:
            joined = joined.withColumn(name, F.coalesce(name, F.lit(default)))
    return joined
