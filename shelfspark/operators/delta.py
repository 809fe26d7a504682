"""Deduplication, change detection, stored rows, parse statistics and the job ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions import products as prod
from shelfspark.schema import PRODUCT_FIELDS

KEYS = ["tenant", "sku"]
ERROR_SAMPLE = 50
FLOAT_TOLERANCE = 1e-6


def dedupe_last_wins(products: DataFrame, order: str = "feed_seq") -> DataFrame:
    """The last row per (tenant, sku), with first_seq (output order) and copies.

    One aggregate, combined before the shuffle, so a sku repeated in a third of the feed
    costs one row per task.
    """
    rest = [c for c in products.columns if c not in KEYS]
    return (products.groupBy(*KEYS)
            .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"),
                 F.min(order).alias("first_seq"), F.count("*").alias("copies"))
            .select(*KEYS, "_last.*", "first_seq", "copies"))


def with_content_hash(products: DataFrame) -> DataFrame:
    return products.withColumn("content_hash", prod.content_hash())


def join_delta(products: DataFrame, stored_hashes: DataFrame) -> DataFrame:
    """Products with status new, changed or unchanged against the stored hashes."""
    before = stored_hashes.select(*KEYS, F.col("content_hash").alias("_before"),
                                  F.lit(True).alias("_stored"))
    return (products.join(before, KEYS, "left")
            .withColumn("status", F.when(F.col("_stored").isNull(), "new")
                        .when(F.col("_before").eqNullSafe(F.col("content_hash")), "unchanged")
                        .otherwise("changed"))
            .drop("_before", "_stored"))


def changes(delta: DataFrame) -> DataFrame:
    """Rows to embed and write."""
    return delta.where(F.col("status") != "unchanged").drop("status")


def missing_from_feed(stored: DataFrame, products: DataFrame) -> DataFrame:
    """Stored skus the parsed feed does not hold, among the feed's tenants.

    A stored product whose new row was rejected is not in the parsed feed, hence listed.
    """
    return stored.select(*KEYS).join(products.select(*KEYS), KEYS, "left_anti").join(
        products.select("tenant").distinct(), "tenant", "left_semi")


def stored_projection(products: DataFrame) -> DataFrame:
    """Products as stored: index text, JSON attributes, gender, hash and key."""
    attributes = F.col("attributes")
    return products.select(
        "tenant", "sku", "title", "description", "brand", "category_path",
        F.try_element_at(attributes, F.lit("gender")).alias("gender"),
        F.col("price").cast("double").alias("price"),
        F.col("original_price").cast("double").alias("original_price"),
        "currency", "in_stock", "rating", "review_count",
        prod.attributes_text(attributes).alias("attributes_text"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attributes))))
         .alias("attributes_json"),
        "image_url", "product_url",
        prod.content_hash().alias("content_hash"),
        prod.object_id(F.col("tenant"), F.col("sku")).alias("object_id"))


def hit_projection(stored: DataFrame, score: Column | float = 1.0,
                   rank: Column | int = 0) -> DataFrame:
    """Stored rows as search hits."""
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    return stored.select(
        "tenant", "sku", "title", as_column(score).cast("double").alias("score"), "brand",
        F.col("price").cast("decimal(18,4)").alias("price"), "currency",
        F.coalesce("in_stock", F.lit(True)).alias("in_stock"), "image_url",
        F.coalesce("category_path", F.array().cast("array<string>")).alias("category_path"),
        "gender", prod.attributes_from_json(F.col("attributes_json")).alias("attributes"),
        F.col("rating").cast("decimal(6,3)").alias("rating"),
        as_column(rank).cast("int").alias("rank_before_rerank"))


def citable_evidence(hits: DataFrame) -> DataFrame:
    """Hits as evidence: what an answer may cite, tagged as products."""
    return hits.select(
        "tenant", F.lit("product").alias("kind"), "sku", "title", "brand",
        F.col("price").cast("string").alias("price"), "currency", "in_stock", "category_path",
        F.col("rating").cast("string").alias("rating"), "image_url")


def raw_replay(products: DataFrame, order: str = "feed_seq") -> DataFrame:
    """The winning raw row per sku."""
    return products.groupBy(*KEYS).agg(F.max_by("raw", order).alias("raw"))


def reason_bucket(reason: Column) -> Column:
    """Reason text before its first bracket."""
    return F.trim(F.get(F.split(reason, r"\("), F.lit(0)))


def parse_stats(mapped: DataFrame) -> DataFrame:
    """Per tenant: total, ok, failed, duplicates, success_rate and counts per reason."""
    ok = F.col("error_reason").isNull()
    by_key = mapped.groupBy("tenant", F.when(ok, F.col("sku")).alias("_sku"),
                            reason_bucket(F.col("error_reason")).alias("_reason")).agg(
        F.count("*").alias("_n"))
    by_reason = by_key.groupBy("tenant", "_reason").agg(
        F.sum("_n").alias("_n"),
        F.sum(F.when(F.col("_sku").isNotNull(), F.col("_n") - 1).otherwise(0)).alias("_dup"))
    good = F.col("_reason").isNull()
    counts = by_reason.groupBy("tenant").agg(
        F.sum("_n").alias("total"),
        F.sum(F.when(good, F.col("_n")).otherwise(0)).alias("ok"),
        F.sum(F.when(~good, F.col("_n")).otherwise(0)).alias("failed"),
        F.sum("_dup").alias("duplicates"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(~good, F.struct("_reason", "_n"))))).alias("reasons"))
    return counts.select(
        "tenant", "total", "ok", "failed", "duplicates",
        F.coalesce(F.try_divide("ok", "total"), F.lit(0.0)).alias("success_rate"), "reasons")


def ingest_outcome(delta: DataFrame, deleted: DataFrame, stats: DataFrame) -> DataFrame:
    """Per tenant: indexed, unchanged, deleted, failed and the job's status."""
    moved = delta.groupBy("tenant").agg(
        F.count_if(F.col("status") != "unchanged").alias("indexed"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"))
    gone = deleted.groupBy("tenant").agg(F.count("*").alias("deleted"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return (stats.join(moved, "tenant", "left").join(gone, "tenant", "left")
            .select("tenant", zero("indexed"), zero("unchanged"), zero("deleted"), "failed",
                    F.when(F.col("failed") > 0, "partial").otherwise("succeeded")
                    .alias("status")))


def error_sample(errors: DataFrame, limit: int = ERROR_SAMPLE) -> DataFrame:
    """The first errors per tenant, with the total and whether the list was cut."""
    first = (errors.withColumn("_rn", F.row_number().over(
        W.partitionBy("tenant").orderBy("feed_seq"))).where(F.col("_rn") <= limit))
    listed = first.groupBy("tenant").agg(F.array_sort(F.collect_list(
        F.struct("feed_seq", "error_reason"))).alias("errors"))
    totals = errors.groupBy("tenant").agg(F.count("*").alias("n_errors"))
    return totals.join(listed, "tenant").withColumn("truncated", F.col("n_errors") > limit)


def job_ledger(outcome: DataFrame, stats: DataFrame, errors: DataFrame) -> DataFrame:
    """One ledger row per tenant's job."""
    return (outcome.join(stats.drop("failed"), "tenant")
            .join(error_sample(errors), "tenant", "left")
            .select("tenant", "status", "total", "ok", "failed", "duplicates", "indexed",
                    "unchanged", "deleted",
                    F.to_json("errors").alias("errors_json"),
                    F.coalesce("truncated", F.lit(False)).alias("truncated")))


def failed_jobs(feed: DataFrame, reason: str) -> DataFrame:
    """One ledger row per tenant of a batch that could not be ingested; its counts are unknown."""
    unknown = [F.lit(None).cast("long").alias(c) for c in
               ("total", "ok", "failed", "duplicates", "indexed", "unchanged", "deleted")]
    return feed.select("tenant").distinct().select(
        "tenant", F.lit("failed").alias("status"), *unknown,
        F.to_json(F.array(F.struct(F.lit(reason).alias("error_reason")))).alias("errors_json"),
        F.lit(False).alias("truncated"))


def latest_jobs(jobs: DataFrame, key: str = "tenant", at: str = "created_at") -> DataFrame:
    """The newest job per tenant."""
    rest = [c for c in jobs.columns if c != key]
    return jobs.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_j")).select(key, "_j.*")


COMPARED = [name for name in PRODUCT_FIELDS if name not in ("attributes",)] + [
    "gender", "attributes_text", "content_hash"]


def roundtrip_diff(expected: DataFrame, stored: DataFrame,
                   compared: list[str] | None = None) -> DataFrame:
    """Every difference between expected and stored rows: (tenant, sku, field).

    A missing row is one issue named ``missing``; floats may differ by the tolerance;
    rows only the store has are not reported.
    """
    names = compared or [c for c in COMPARED if c in expected.columns and c in stored.columns]
    types = dict(expected.dtypes)
    pairs = expected.select(*KEYS, *names).join(
        stored.select(*KEYS, F.lit(True).alias("_found"),
                      *[F.col(n).alias(f"_s_{n}") for n in names]), KEYS, "left")

    def differs(name: str) -> Column:
        want, have = F.col(name), F.col(f"_s_{name}")
        if types[name] in ("double", "float"):
            close = F.abs(want - have) <= FLOAT_TOLERANCE
            return ~F.coalesce(close, want.isNull() & have.isNull())
        return ~want.eqNullSafe(have)

    found = F.array_compact(F.array(*[F.when(differs(n), F.lit(n)) for n in names]))
    issues = F.when(F.col("_found").isNull(), F.array(F.lit("missing"))).otherwise(found)
    return pairs.select(*KEYS, F.explode(issues).alias("field"))
