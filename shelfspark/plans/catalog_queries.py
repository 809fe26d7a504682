"""Stored catalog, change detection, filters and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators import delta, filters
from shelfspark.operators import feed_mapping as fm
from shelfspark.operators.ranks import dense_index
from shelfspark.plans import feed_queries as fq
from shelfspark.plans import standins as st
from shelfspark.plans.registry import register, table
from shelfspark.plans.shapes import plain
from shelfspark.session import scratch_path
from shelfspark.sources import catalog

P_SQL = f"WITH {st.PRODUCTS_SQL}"


def _n(column: str = "sku"):
    return F.substring(column, 3, 20).try_cast("long")


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    return st.products(spark, sf).select("tenant", "sku", "title", F.col("price").cast("double")
                                         .alias("price"))


def _changes(existing: DataFrame) -> DataFrame:
    """Every fifth product repriced, every seventh renamed into a new sku."""
    repriced = existing.where(_n() % 5 == 0).withColumn("price", F.lit(1.0))
    added = existing.where(_n() % 7 == 0).withColumn("sku", F.concat("sku", F.lit("-new")))
    return repriced.unionByName(added)


UPSERT_SQL = f"""{P_SQL},
e AS (SELECT tenant, sku, title, CAST(price AS DOUBLE) AS price, p_partkey FROM products),
c AS (SELECT tenant, sku, title, CAST(1.0 AS DOUBLE) AS price FROM e WHERE p_partkey % 5 = 0
  UNION ALL SELECT tenant, sku || '-new', title, price FROM e WHERE p_partkey % 7 = 0),
merged AS (SELECT tenant, sku, title, price FROM e
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.tenant = e.tenant AND c.sku = e.sku)
  UNION ALL SELECT * FROM c)"""


@register("src_catalog_scan", f"""{P_SQL}
SELECT sku, title, round(CAST(price AS DOUBLE), 6) AS price FROM products WHERE tenant = 't1'""")
def src_catalog_scan(spark, sf):
    store = catalog.CatalogTable(spark, scratch_path(spark, "catalog"), buckets=4)
    store.upsert(_existing(spark, sf))
    return plain(store.scan("t1", ["sku", "title", "price"]))


@register("sink_upsert", f"""{UPSERT_SQL}
SELECT tenant, sku, title, round(price, 6) AS price FROM merged""")
def sink_upsert(spark, sf):
    existing = _existing(spark, sf)
    changes = _changes(existing)
    once = catalog.merge_upsert(existing, changes)
    return plain(catalog.merge_upsert(once, changes))


@register("sink_upsert_table", f"""{UPSERT_SQL}
SELECT tenant, sku, title, round(price, 6) AS price FROM merged WHERE sku NOT LIKE '%0'""")
def sink_upsert_table(spark, sf):
    """Write, upsert twice, delete, and read the stored table back."""
    store = catalog.CatalogTable(spark, scratch_path(spark, "catalog"), buckets=4)
    existing = _existing(spark, sf)
    store.upsert(existing)
    store.upsert(_changes(existing))
    store.upsert(_changes(existing))
    store.delete(existing.where(F.col("sku").endswith("0")))
    return plain(store.scan().select("tenant", "sku", "title", "price"))


@register("sink_delete_keys", f"""{P_SQL}
SELECT tenant, count(*) AS deleted FROM products WHERE p_partkey % 9 = 0 GROUP BY 1""")
def sink_delete_keys(spark, sf):
    existing = _existing(spark, sf)
    keys = existing.where(_n() % 9 == 0).select("tenant", "sku").unionByName(
        existing.select("tenant", F.concat("sku", F.lit("-unknown")).alias("sku")))
    return catalog.count_deleted(existing, keys)


@register("sink_drop_tenant", f"""{P_SQL}
SELECT tenant, count(*) AS n FROM products WHERE tenant <> 't1' GROUP BY 1""")
def sink_drop_tenant(spark, sf):
    store = catalog.CatalogTable(spark, scratch_path(spark, "catalog"), buckets=4)
    store.upsert(_existing(spark, sf))
    store.drop_tenant("t1")
    return store.scan().groupBy("tenant").agg(F.count("*").alias("n"))


@register("sink_raw_replay", f"""{fq.MAPPED_SQL}
SELECT d.tenant, sku, d.mrp, f.stars FROM deduped d JOIN feed f USING (feed_seq)""")
def sink_raw_replay(spark, sf):
    replay = delta.raw_replay(fm.accepted(fq.mapped(spark, sf, keep_raw=True)))
    return replay.select("tenant", "sku", *[
        F.try_element_at("raw", F.lit(c)).alias(c) for c in ("mrp", "stars")])


@register("schema_evolve", """
SELECT p_partkey, p_name, CAST(NULL AS BIGINT) AS review_count, CAST(NULL AS VARCHAR) AS gender
FROM part""")
def schema_evolve(spark, sf):
    wanted = T.StructType([T.StructField("p_name", T.StringType()),
                           T.StructField("review_count", T.LongType()),
                           T.StructField("gender", T.StringType())])
    return catalog.add_missing_columns(table(spark, sf, "part").select("p_partkey", "p_name"),
                                       wanted)


# --- deduplication and deltas ---------------------------------------------------------

@register("dedupe_last_wins", f"""{fq.MAPPED_SQL}
SELECT tenant, sku, feed_seq, first_seq, copies, round(price, 6) AS price FROM deduped""")
def dedupe_last_wins(spark, sf):
    return plain(fq.deduped(spark, sf).select("tenant", "sku", "feed_seq", "first_seq", "copies",
                                              "price"))


@register("dedupe_output_order", f"""{fq.MAPPED_SQL}
SELECT tenant, sku, row_number() OVER (PARTITION BY tenant ORDER BY first_seq) AS index
FROM deduped""")
def dedupe_output_order(spark, sf):
    kept = fq.deduped(spark, sf).select("tenant", "sku", "first_seq")
    return dense_index(kept, ["tenant"], [F.col("first_seq")],
                       F.floor(F.col("first_seq") / 512)).drop("first_seq")


def _stored_hashes(products: DataFrame) -> DataFrame:
    """What an earlier run left: one in four missing, one in three stale, one in nine unknown."""
    hashed = delta.with_content_hash(products).select("tenant", "sku", "content_hash")
    n = _n()
    kept = F.when(n % 4 != 0, F.struct(F.col("sku"), F.when(n % 3 == 0, "stale").otherwise(
        F.col("content_hash")).alias("content_hash")))
    gone = F.when(n % 9 == 0, F.struct(F.concat("sku", F.lit("-old")).alias("sku"),
                                       F.col("content_hash")))
    return hashed.select("tenant", F.explode(F.array_compact(F.array(kept, gone))).alias("h")
                         ).select("tenant", "h.*")


DELTA_SQL = f"""{fq.MAPPED_SQL},
keyed AS (SELECT *, CAST(substr(sku, 3) AS BIGINT) AS n FROM deduped),
compared AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'new' WHEN n % 3 = 0 THEN 'changed'
  ELSE 'unchanged' END AS status FROM keyed)"""


def _delta(spark, sf):
    products = fq.deduped(spark, sf)
    return delta.join_delta(delta.with_content_hash(products), _stored_hashes(products)), products


@register("join_delta", f"""{DELTA_SQL} SELECT tenant, sku, status FROM compared""")
def join_delta(spark, sf):
    return _delta(spark, sf)[0].select("tenant", "sku", "status")


@register("join_full_sync", f"""{DELTA_SQL}
SELECT tenant, sku || '-old' AS sku FROM compared WHERE n % 9 = 0""")
def join_full_sync(spark, sf):
    products = fq.deduped(spark, sf)
    return delta.missing_from_feed(_stored_hashes(products), products)


@register("agg_parse_stats", f"""{fq.MAPPED_SQL}
SELECT tenant, count(*) AS total, count(*) FILTER (error_reason IS NULL) AS ok,
  count(*) FILTER (error_reason IS NOT NULL) AS failed,
  count(*) FILTER (error_reason IS NULL) - count(DISTINCT CASE WHEN error_reason IS NULL
    THEN sku END) AS duplicates,
  round(count(*) FILTER (error_reason IS NULL) / count(*), 6) AS success_rate,
  count(*) FILTER (error_reason LIKE 'missing or empty SKU%') AS missing_sku,
  count(*) FILTER (error_reason LIKE 'missing or empty title%') AS missing_title
FROM judged GROUP BY 1""")
def agg_parse_stats(spark, sf):
    stats = delta.parse_stats(fq.mapped(spark, sf))
    reason = lambda name: F.coalesce(F.try_element_at("reasons", F.lit(name)), F.lit(0))
    return plain(stats.select(
        "tenant", "total", "ok", "failed", "duplicates", "success_rate",
        reason("missing or empty SKU").alias("missing_sku"),
        reason("missing or empty title").alias("missing_title")))


OUTCOME_SQL = f"""{DELTA_SQL},
outcome AS (
  SELECT c.tenant, count(*) FILTER (status <> 'unchanged') AS indexed,
    count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (n % 9 = 0) AS deleted
  FROM compared c GROUP BY 1),
failed AS (SELECT tenant, count(*) FILTER (error_reason IS NOT NULL) AS failed, count(*) AS total
  FROM judged GROUP BY 1)"""


def _outcome(spark, sf):
    compared, products = _delta(spark, sf)
    deleted = delta.missing_from_feed(_stored_hashes(products), products)
    stats = delta.parse_stats(fq.mapped(spark, sf))
    return delta.ingest_outcome(compared, deleted, stats), stats


@register("agg_ingest_outcome", f"""{OUTCOME_SQL}
SELECT tenant, indexed, unchanged, deleted, failed,
  CASE WHEN failed > 0 THEN 'partial' ELSE 'succeeded' END AS status
FROM outcome JOIN failed USING (tenant)""")
def agg_ingest_outcome(spark, sf):
    return _outcome(spark, sf)[0]


@register("agg_error_sample", f"""{fq.MAPPED_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY feed_seq) AS rn,
  count(*) OVER (PARTITION BY tenant) AS n_errors FROM judged WHERE error_reason IS NOT NULL)
SELECT tenant, n_errors, n_errors > 50 AS truncated,
  string_agg(CAST(feed_seq AS VARCHAR), '|' ORDER BY feed_seq) AS rows
FROM numbered WHERE rn <= 50 GROUP BY ALL""")
def agg_error_sample(spark, sf):
    sample = delta.error_sample(fm.rejected(fq.mapped(spark, sf)))
    return plain(sample.select("tenant", "n_errors", "truncated",
                               F.col("errors.feed_seq").alias("rows")))


@register("sink_job_ledger", f"""{OUTCOME_SQL}
SELECT tenant, 'partial' AS status, total, failed, indexed, unchanged, deleted,
  failed > 50 AS truncated FROM outcome JOIN failed USING (tenant)""")
def sink_job_ledger(spark, sf):
    outcome, stats = _outcome(spark, sf)
    ledger = delta.job_ledger(outcome, stats, fm.rejected(fq.mapped(spark, sf)))
    path = scratch_path(spark, "ledger")
    ledger.write.mode("append").parquet(path)
    return spark.read.parquet(path).select("tenant", "status", "total", "failed", "indexed",
                                           "unchanged", "deleted", "truncated")


@register("latest_jobs", """
SELECT 'm' || (user_id % 5) AS tenant, max(event_id) AS event_id,
  arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def latest_jobs(spark, sf):
    jobs = table(spark, sf, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("tenant"), "event_id",
        "event_type", F.struct("ts", "event_id").alias("created_at"))
    return delta.latest_jobs(jobs).drop("created_at")


@register("join_roundtrip_diff", f"""{P_SQL},
fields AS (SELECT tenant, sku, p_partkey AS n, price FROM products)
SELECT tenant, sku, 'missing' AS field FROM fields WHERE n % 6 = 0
UNION ALL SELECT tenant, sku, 'price' FROM fields WHERE n % 6 <> 0 AND n % 5 = 0
  AND price IS NOT NULL
UNION ALL SELECT tenant, sku, 'title' FROM fields WHERE n % 6 <> 0 AND n % 7 = 0""")
def join_roundtrip_diff(spark, sf):
    expected = delta.stored_projection(st.products(spark, sf))
    n = _n()
    noise = F.when(n % 5 == 0, 0.01).otherwise(1e-9)
    stored = expected.where(n % 6 != 0).withColumns({
        "price": F.col("price") + noise,
        "title": F.when(n % 7 == 0, F.upper("title")).otherwise(F.col("title"))})
    extra = stored.withColumn("sku", F.concat("sku", F.lit("-extra")))
    return delta.roundtrip_diff(expected, stored.unionByName(extra))


# --- filters and statistics -----------------------------------------------------------

@register("agg_catalog_stats", f"""{P_SQL}
SELECT tenant, count(*) AS count, round(CAST(min(price) AS DOUBLE), 6) AS minimum,
  round(CAST(max(price) AS DOUBLE), 6) AS maximum, round(avg(CAST(price AS DOUBLE)), 6) AS mean
FROM products WHERE brand IN ('Brand#2', 'Brand#4', 'Brand#11') AND in_stock GROUP BY 1""")
def agg_catalog_stats(spark, sf):
    return plain(filters.catalog_stats(
        st.products(spark, sf), brands=["Brand#2", "Brand#4", "Brand#11"], in_stock_only=True))


@register("agg_catalog_stats_slice", """
SELECT 't' || (p_partkey % 3) AS tenant, count(*) AS count, min(p_retailprice) AS minimum,
  max(p_retailprice) AS maximum, round(avg(p_retailprice), 6) AS mean
FROM part
WHERE p_retailprice >= 950 AND p_brand IN ('Brand#2', 'Brand#4') AND p_size % 5 <> 0
GROUP BY 1""")
def agg_catalog_stats_slice(spark, sf):
    part = table(spark, sf, "part").select(
        F.concat(F.lit("t"), (F.col("p_partkey") % 3).cast("string")).alias("tenant"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").cast("decimal(18,4)")
        .alias("price"), (F.col("p_size") % 5 != 0).alias("in_stock"))
    return plain(filters.catalog_stats(part, min_price=950, brands=["Brand#2", "Brand#4"],
                                       in_stock_only=True))


@register("agg_catalog_stats_rating", f"""{P_SQL}
SELECT tenant, count(*) AS count, round(min(rating), 6) AS minimum,
  round(max(rating), 6) AS maximum, round(avg(rating), 6) AS mean
FROM products WHERE list_has_any(category_path, ['ECONOMY', 'ring']) GROUP BY 1""")
def agg_catalog_stats_rating(spark, sf):
    return plain(filters.catalog_stats(st.products(spark, sf, reviews=True), "rating",
                                       categories=["ECONOMY", "ring"]))


FILTER_SQL = f"""{P_SQL}
SELECT tenant, sku FROM products
WHERE price >= 920 AND price <= 980.5 AND list_has_any(category_path, ['PROMO', 'gear', 'bolt'])
  AND in_stock AND gender IN ('Men', 'Women') AND rating >= 4.7"""


@register("filter_search", FILTER_SQL)
def filter_search(spark, sf):
    return filters.where_filters(
        st.products(spark, sf, reviews=True), min_price=920, max_price="980.5",
        categories=["PROMO", "gear", "bolt"], in_stock_only=True, genders=["Men", "Women"],
        min_rating=4.7).select("tenant", "sku")


def _tool_calls(spark, sf):
    """One tool call per customer, arguments as text the way a model sends them."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("rid"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("tenant"),
        F.when(k % 3 == 0, "rating").otherwise("price").alias("metric"),
        F.struct(
            F.when(k % 2 == 0, (900 + k % 80).cast("string")).alias("min_price"),
            F.when(k % 5 == 0, "a lot").alias("max_price"),
            F.when(k % 4 == 0, F.concat(F.lit("Brand#"), (k % 25).cast("string"))).alias("brand"),
            F.when(k % 7 == 0, "PROMO").otherwise("").alias("category"),
            F.when(k % 3 == 1, "true").alias("in_stock_only"),
            F.when(k % 6 == 0, "Men").alias("gender"),
            F.when(k % 11 == 0, "4.75").alias("min_rating")).alias("args"))


CALLS_SQL = """calls AS (
  SELECT c_custkey AS rid, 't' || (c_custkey % 3) AS tenant,
    CASE WHEN c_custkey % 3 = 0 THEN 'rating' ELSE 'price' END AS metric,
    CASE WHEN c_custkey % 2 = 0 THEN CAST(900 + c_custkey % 80 AS DOUBLE) END AS min_price,
    CASE WHEN c_custkey % 4 = 0 THEN 'Brand#' || (c_custkey % 25) END AS brand_arg,
    CASE WHEN c_custkey % 7 = 0 THEN 'PROMO' END AS category_arg,
    coalesce(c_custkey % 3 = 1, false) AS in_stock_only,
    CASE WHEN c_custkey % 6 = 0 THEN 'Men' END AS gender_arg,
    CASE WHEN c_custkey % 11 = 0 THEN 4.75 END AS min_rating FROM customer)"""


@register("filter_from_tool_args", f"""WITH {CALLS_SQL}
SELECT rid, min_price, CAST(NULL AS DOUBLE) AS max_price, brand_arg AS brands,
  category_arg AS categories, in_stock_only, gender_arg AS genders,
  CAST(min_rating AS DOUBLE) AS min_rating FROM calls""")
def filter_from_tool_args(spark, sf):
    return plain(filters.from_tool_args(_tool_calls(spark, sf)).select("rid", "filters.*"))


@register("agg_catalog_stats_many", f"""{P_SQL}, {CALLS_SQL},
met AS (
  SELECT rid, CASE WHEN metric = 'price' THEN CAST(price AS DOUBLE) ELSE rating END AS v
  FROM calls c JOIN products p ON p.tenant = c.tenant
    AND (c.min_price IS NULL OR coalesce(p.price >= c.min_price, false))
    AND (brand_arg IS NULL OR coalesce(brand = brand_arg, false))
    AND (category_arg IS NULL OR list_contains(category_path, category_arg))
    AND (NOT in_stock_only OR in_stock)
    AND (gender_arg IS NULL OR coalesce(gender = gender_arg, false))
    AND (c.min_rating IS NULL OR coalesce(rating >= c.min_rating, false)))
SELECT c.rid, c.tenant, c.metric, count(met.rid) AS count, round(min(v), 6) AS minimum,
  round(max(v), 6) AS maximum, round(avg(v), 9) AS mean
FROM calls c LEFT JOIN met ON met.rid = c.rid GROUP BY ALL""")
def agg_catalog_stats_many(spark, sf):
    asked = filters.from_tool_args(_tool_calls(spark, sf)).drop("args")
    stats = filters.catalog_stats_many(asked, st.products(spark, sf, reviews=True))
    return plain(stats.drop("mean")).join(stats.select("rid", F.round("mean", 9).alias("mean")),
                                          "rid")


@register("filter_tenant", f"""{P_SQL}
SELECT sku FROM products WHERE tenant = 't2'""")
def filter_tenant(spark, sf):
    return st.products(spark, sf).where(F.col("tenant") == "t2").select("sku")


@register("filter_preview", f"""{P_SQL}
SELECT sku, title FROM products WHERE tenant = 't0' AND brand = 'Brand#3'
ORDER BY sku LIMIT 10""")
def filter_preview(spark, sf):
    return filters.preview(st.products(spark, sf), 10, tenant="t0", brand="Brand#3").select(
        "sku", "title")


def _wanted(spark, sf):
    """Skus ordered in every line, some of another tenant and some unknown."""
    k = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("t"), ((k + F.col("l_linenumber") % 2) % 3).cast("string")).alias("tenant"),
        F.when(k % 10 == 0, "P-none").otherwise(F.concat(F.lit("P-"), k.cast("string")))
        .alias("sku")).distinct()


WANTED_SQL = """wanted AS (
  SELECT DISTINCT 't' || ((l_partkey + l_linenumber % 2) % 3) AS tenant,
    CASE WHEN l_partkey % 10 = 0 THEN 'P-none' ELSE 'P-' || l_partkey END AS sku FROM lineitem)"""


@register("join_exact_skus", f"""{P_SQL}, {WANTED_SQL}
SELECT tenant, sku, CAST(1.0 AS DOUBLE) AS score, title FROM products JOIN wanted
  USING (tenant, sku)""")
def join_exact_skus(spark, sf):
    stored = delta.stored_projection(st.products(spark, sf))
    found = filters.get_by_skus(stored, _wanted(spark, sf))
    return plain(delta.hit_projection(found).select("tenant", "sku", "score", "title"))


@register("join_not_found", f"""{P_SQL}, {WANTED_SQL}
SELECT tenant, sku FROM wanted WHERE NOT EXISTS (
  SELECT 1 FROM products p WHERE p.tenant = wanted.tenant AND p.sku = wanted.sku)""")
def join_not_found(spark, sf):
    return filters.not_found(st.products(spark, sf), _wanted(spark, sf))
