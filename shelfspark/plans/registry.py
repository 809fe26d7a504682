"""Named queries over a table folder, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql.strip()
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; its zone-less times are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    times = [c for c, t in rows.dtypes if t == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else rows
