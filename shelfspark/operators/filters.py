"""Structured search filters and catalog statistics over them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.ranks import spread_join
from shelfspark.schema import FILTER_FIELDS

MAX_BRANDS, MAX_CATEGORIES, MAX_GENDERS = 20, 20, 5
METRICS = ("price", "rating", "review_count")


def where_filters(products: DataFrame, min_price: Any = None, max_price: Any = None,
                  brands: Sequence[str] = (), categories: Sequence[str] = (),
                  in_stock_only: bool = False, genders: Sequence[str] = (),
                  min_rating: float | None = None, ignore_case: bool = False) -> DataFrame:
    """Products meeting every given clause; a null field fails its clause."""
    if len(brands) > MAX_BRANDS or len(categories) > MAX_CATEGORIES or len(genders) > MAX_GENDERS:
        raise ValueError("too many filter values")
    clauses = []
    if min_price is not None:
        clauses.append(F.col("price") >= F.lit(min_price).cast("decimal(18,4)"))
    if max_price is not None:
        clauses.append(F.col("price") <= F.lit(max_price).cast("decimal(18,4)"))
    if brands:
        clauses.append(F.lower("brand").isin([b.lower() for b in brands]) if ignore_case
                       else F.col("brand").isin(list(brands)))
    if categories:
        clauses.append(F.arrays_overlap("category_path", F.array(*map(F.lit, categories))))
    if in_stock_only:
        clauses.append(F.col("in_stock"))
    if genders:
        clauses.append(F.col("gender").isin(list(genders)))
    if min_rating is not None:
        clauses.append(F.col("rating") >= F.lit(min_rating))
    for clause in clauses:
        products = products.where(clause)
    return products


def from_tool_args(args: DataFrame, column: str = "args") -> DataFrame:
    """Filter structs from single-valued tool arguments."""
    a = F.col(column)

    def one(name: str) -> Column:
        return F.when(F.coalesce(a[name], F.lit("")) != "", F.array(a[name]))

    return args.withColumn("filters", F.struct(
        a["min_price"].try_cast("decimal(18,4)").alias("min_price"),
        a["max_price"].try_cast("decimal(18,4)").alias("max_price"),
        one("brand").alias("brands"), one("category").alias("categories"),
        F.coalesce(a["in_stock_only"].try_cast("boolean"), F.lit(False)).alias("in_stock_only"),
        one("gender").alias("genders"),
        a["min_rating"].try_cast("double").alias("min_rating")))


def no_filters() -> Column:
    return F.from_json(F.lit("{}"), FILTER_FIELDS)


def matches(f: Column) -> Column:
    """The same clauses with the filter struct as a column (a join condition)."""
    def unless_empty(values: Column, test: Column) -> Column:
        return values.isNull() | (F.size(values) == 0) | F.coalesce(test, F.lit(False))

    def unless_null(bound: Column, test: Column) -> Column:
        return bound.isNull() | F.coalesce(test, F.lit(False))

    return (
        unless_null(f["min_price"], F.col("price") >= f["min_price"])
        & unless_null(f["max_price"], F.col("price") <= f["max_price"])
        & unless_null(f["min_rating"], F.col("rating") >= f["min_rating"])
        & (~F.coalesce(f["in_stock_only"], F.lit(False))
           | F.coalesce(F.col("in_stock"), F.lit(False)))
        & unless_empty(f["genders"], F.array_contains(f["genders"], F.col("gender")))
        & unless_empty(f["brands"], F.array_contains(f["brands"], F.col("brand")))
        & unless_empty(f["categories"], F.arrays_overlap("category_path", f["categories"])))


def _stat_columns(metric: str) -> list[Column]:
    value = F.col(metric).cast("double")
    return [F.count("*").alias("count"), F.min(value).alias("minimum"),
            F.max(value).alias("maximum"), F.avg(value).alias("mean")]


def catalog_stats(products: DataFrame, metric: str = "price", **filters: Any) -> DataFrame:
    """Per tenant: matching rows (null metric included) and the metric's min, max and mean."""
    if metric not in METRICS:
        raise ValueError(f"no statistics for {metric!r}")
    return where_filters(products, **filters).groupBy("tenant").agg(*_stat_columns(metric))


def catalog_stats_many(requests: DataFrame, products: DataFrame) -> DataFrame:
    """catalog_stats for a table of requests (rid, tenant, metric, filters).

    Requests that ask the same thing are answered once. Those naming brands meet products
    on (tenant, brand), the others on the tenant, salted either way; every task reduces its
    products to one row per question before the shuffle.
    """
    question = F.concat_ws("/", "tenant", "metric", F.to_json("filters"))
    asked = requests.withColumn("_q", question)
    distinct = asked.select("_q", "tenant", "metric", "filters").dropDuplicates(["_q"])
    brands = F.col("filters.brands")
    named = F.coalesce(F.size(brands) > 0, F.lit(False))
    narrow = products.select("tenant", "sku", "brand", "category_path", "in_stock", "gender",
                             "price", "rating", "review_count")
    by_brand = spread_join(
        narrow, distinct.where(named).withColumn("brand", F.explode(F.array_distinct(brands))),
        ["tenant", "brand"], F.col("sku"))
    by_tenant = spread_join(narrow, distinct.where(~named), ["tenant"], F.col("sku"))
    value = F.when(F.col("metric") == "price", F.col("price").cast("double"))
    value = value.when(F.col("metric") == "rating", F.col("rating"))
    value = value.when(F.col("metric") == "review_count", F.col("review_count").cast("double"))

    def hits(met: DataFrame) -> DataFrame:
        return met.where(matches(F.col("filters"))).select("_q", value.alias("_v"))

    found = hits(by_brand).unionByName(hits(by_tenant)).groupBy("_q").agg(*_stat_columns("_v"))
    return asked.select("rid", "tenant", "metric", "_q").join(found, "_q", "left").drop(
        "_q").withColumn("count", F.coalesce("count", F.lit(0)))


def preview(products: DataFrame, limit: int, **equal: Any) -> DataFrame:
    """The first products with the given field values."""
    for name, value in equal.items():
        products = products.where(F.col(name) == value)
    return products.orderBy("sku").limit(limit)


def get_by_skus(products: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored products for (tenant, sku) requests; unknown skus give no row."""
    return products.join(wanted.select("tenant", "sku").distinct(), ["tenant", "sku"], "left_semi")


def not_found(products: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(products.select("tenant", "sku"), ["tenant", "sku"], "left_anti")
