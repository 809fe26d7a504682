"""Catalog profiling: completeness, distributions, concentration, rules and peer outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.operators.ranks import dense_index, exact_quantiles, top_k

# Thresholds and the outlier test's critical values by number of peers.
FAILURE_RATE_WARN = 0.05
EMPTY_DESCRIPTION_WARN = 0.50
HHI_MIN_SAMPLE = 20
HHI_MODERATE, HHI_HIGH = 0.15, 0.25
FENCE_IQRS = 3.0
DUPLICATE_RATE_FALLBACK = 0.20
GRUBBS_CRITICAL = {
    3: 1.155, 4: 1.481, 5: 1.715, 6: 1.887, 7: 2.020, 8: 2.126, 9: 2.215, 10: 2.290,
    11: 2.355, 12: 2.412, 13: 2.462, 14: 2.507, 15: 2.549,
}
SUMMARY_QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def field_checks() -> dict[str, Column]:
    """What counts as filled, per field."""
    checks = {name: _text(name) for name in
              ("brand", "currency", "image_url", "product_url", "description")}
    checks |= {name: F.col(name).isNotNull() for name in
               ("price", "original_price", "rating", "review_count")}
    checks |= {name: F.coalesce(F.size(name), F.lit(0)) > 0 for name in
               ("category_path", "attributes")}
    return checks


def completeness(products: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """(tenant, field, fraction) in one scan."""
    checks = checks or field_checks()
    wide = products.groupBy("tenant").agg(*[
        F.avg(F.when(check, 1.0).otherwise(0.0)).alias(name) for name, check in checks.items()])
    return wide.unpivot("tenant", list(checks), "field", "fraction")


def numeric_summary(products: DataFrame, column: str | Column) -> DataFrame:
    """Count, nulls, extremes, mean and nearest-rank quartiles per tenant."""
    value = F.col(column) if isinstance(column, str) else column
    return exact_quantiles(products, ["tenant"], value, SUMMARY_QUANTILES)


def category_counts(products: DataFrame) -> DataFrame:
    """(tenant, label, n, first_seq) over products that have a path."""
    seq = F.min("feed_seq") if "feed_seq" in products.columns else F.lit(None).cast("long")
    return (products.where(F.coalesce(F.size("category_path"), F.lit(0)) > 0)
            .groupBy("tenant", F.array_join("category_path", " > ").alias("label"))
            .agg(F.count("*").alias("n"), seq.alias("first_seq")))


def category_diversity(products: DataFrame) -> DataFrame:
    """Per tenant: products_with_category, distinct_categories, top label, top_share, hhi."""
    counts = category_counts(products)
    totals = counts.groupBy("tenant").agg(
        F.sum("n").alias("products_with_category"), F.count("*").alias("distinct_categories"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("_squares"),
        F.max(F.struct("n", (-F.coalesce("first_seq", F.lit(0))).alias("s"), "label"))
         .alias("_top"))
    n = F.col("products_with_category")
    return totals.select(
        "tenant", "products_with_category", "distinct_categories",
        F.col("_top.label").alias("top_label"), (F.col("_top.n") / n).alias("top_share"),
        (F.col("_squares") / (n.cast("double") * n)).alias("hhi"))


def top_categories(products: DataFrame, n: int = 5) -> DataFrame:
    """Most common labels per tenant; ties go to the label seen first."""
    order = [F.desc("n"), F.asc("first_seq"), F.asc("label")]
    return top_k(category_counts(products), ["tenant"], order, n).select(
        "tenant", "rank", "label", "n")


def top_prices(products: DataFrame, n: int = 3) -> DataFrame:
    """Highest priced products per tenant."""
    return top_k(products.where(F.col("price").isNotNull()), ["tenant"],
                 [F.desc("price"), F.asc("sku")], n).select("tenant", "rank", "sku", "price")


def duplicate_rates(stats: DataFrame) -> DataFrame:
    return stats.select("tenant", F.coalesce(
        F.try_divide("duplicates", "total"), F.lit(0.0)).alias("rate"))


def duplicate_outliers(rates: DataFrame) -> DataFrame:
    """Tenants whose duplicate rate stands out among their peers (tenant, rate, g, critical).

    From three tenants on, only the highest rate is tested; below that a fixed limit holds.
    """
    peers = rates.agg(F.count("*").alias("n"), F.avg("rate").alias("mean"),
                      F.stddev_pop("rate").alias("sd"),
                      F.max(F.struct("rate", F.col("tenant"))).alias("top"))
    last = max(GRUBBS_CRITICAL)
    table = F.create_map(*[F.lit(x) for pair in GRUBBS_CRITICAL.items() for x in pair])
    g = F.try_divide(F.col("rate") - F.col("mean"), F.col("sd"))
    critical = F.try_element_at(table, F.least(F.col("n"), F.lit(last)).cast("int"))
    scored = rates.crossJoin(F.broadcast(peers)).withColumns({"g": g, "critical": critical})
    few = F.col("n") < 3
    flagged = F.when(few, F.col("rate") > DUPLICATE_RATE_FALLBACK).otherwise(
        (F.col("tenant") == F.col("top.tenant")) & (F.col("g") > F.col("critical")))
    return scored.where(flagged).select(
        "tenant", "rate", F.when(~few, F.col("g")).alias("g"),
        F.when(~few, F.col("critical")).alias("critical"))


def rule_flags(profile: DataFrame) -> DataFrame:
    """(tenant, severity, rule, value) for every rule a tenant's profile breaks.

    The profile has total, failed, products_with_category, hhi, price_count, price_min,
    price_p25, price_p75, price_max, rating_max and description.
    """
    failure = F.try_divide("failed", "total")
    iqr = F.log10("price_p75") - F.log10("price_p25")
    fence = F.log10("price_p75") + FENCE_IQRS * iqr
    empty = 1 - F.coalesce(F.col("description"), F.lit(0.0))
    concentrated = F.col("products_with_category") >= HHI_MIN_SAMPLE
    hhi = F.col("hhi")
    rules = [
        ("warning", "parse_failures", failure, failure > FAILURE_RATE_WARN),
        ("warning", "category_highly_concentrated", hhi, concentrated & (hhi > HHI_HIGH)),
        ("warning", "category_moderately_concentrated", hhi,
         concentrated & (hhi > HHI_MODERATE) & (hhi <= HHI_HIGH)),
        ("critical", "price_not_positive", F.col("price_min"), F.col("price_min") <= 0),
        ("warning", "price_far_out", F.col("price_max"),
         (F.col("price_p25") > 0) & (iqr > 0) & (F.log10("price_max") > fence)),
        ("critical", "rating_above_scale", F.col("rating_max"), F.col("rating_max") > 5),
        ("warning", "descriptions_missing", empty, empty > EMPTY_DESCRIPTION_WARN),
    ]
    raised = F.array_compact(F.array(*[
        F.when(broken, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                                value.cast("double").alias("value")))
        for severity, rule, value, broken in rules]))
    return profile.select("tenant", F.explode(raised).alias("f")).select("tenant", "f.*")


def profile(products: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per tenant holding everything the rules look at."""
    def summary(column: str) -> DataFrame:
        s = numeric_summary(products, column)
        return s.select("tenant", *[F.col(c).alias(f"{column}_{c}")
                                    for c in s.columns if c != "tenant"])

    filled = products.groupBy("tenant").agg(*[
        F.avg(F.when(check, 1.0).otherwise(0.0)).alias(name)
        for name, check in field_checks().items() if name == "description"])
    parts = [stats.select("tenant", "total", "failed", "duplicates"),
             filled, category_diversity(products), summary("price"), summary("rating")]
    return reduce(lambda a, b: a.join(b, "tenant", "left"), parts)


def quality_report(products: DataFrame, stats: DataFrame) -> DataFrame:
    """All flags of all tenants, the peer comparison of duplicate rates included."""
    peers = duplicate_outliers(duplicate_rates(stats)).select(
        "tenant", F.lit("warning").alias("severity"), F.lit("duplicate_rate").alias("rule"),
        F.col("rate").alias("value"))
    return rule_flags(profile(products, stats)).unionByName(peers)


def severity_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("severity").agg(F.count("*").alias("n"))


def even_sample(rows: DataFrame, n: int, keys: list[str], order: str, bucket: Column,
                name: str = "index") -> DataFrame:
    """n rows per key, evenly spread over its order; all rows when there are no more than n."""
    indexed = dense_index(rows, keys, [F.col(order)], bucket, name)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    zero = F.col(name) - 1
    step = F.col("_size") / F.lit(n)
    at = F.ceil(zero / step)

    def lands(i: Column) -> Column:
        return (i >= 0) & (i < n) & (F.floor(i.cast("double") * step) == zero)

    # Row r is picked when some i has floor(i * step) = r; rounding may put i one lower.
    picked = (F.col("_size") <= n) | lands(at) | lands(at - 1)
    return indexed.join(sizes, keys).where(picked).drop("_size")


def stride_anchors(rows: DataFrame, anchors: int, first: int, keys: list[str], order: str,
                   bucket: Column) -> DataFrame:
    """Every (size // anchors)-th of the first rows per key."""
    head = top_k(rows, keys, [F.col(order)], first, rank="index")
    size = F.max("index").over(W.partitionBy(*keys))
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / anchors))
    return (head.withColumn("_size", size)
            .where((F.col("index") - 1) % step == 0).drop("_size"))
