"""Catalog profiling, embedding quality and enrichment."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.usage import with_cost
from shelfspark.functions.vectors import cosine_similarity
from shelfspark.operators import delta, embeddings, enrich, quality
from shelfspark.operators import feed_mapping as fm
from shelfspark.operators.telemetry import enrich_cost
from shelfspark.plans import feed_queries as fq
from shelfspark.plans import standins as st
from shelfspark.plans.registry import register, table
from shelfspark.plans.shapes import plain

P_SQL = f"WITH {st.PRODUCTS_SQL}"


@register("agg_completeness", f"""{P_SQL},
wide AS (SELECT tenant, avg(CASE WHEN coalesce(brand, '') <> '' THEN 1.0 ELSE 0 END) AS brand,
  avg(CASE WHEN len(category_path) > 0 THEN 1.0 ELSE 0 END) AS category_path,
  avg(CASE WHEN price IS NOT NULL THEN 1.0 ELSE 0 END) AS price,
  avg(CASE WHEN original_price IS NOT NULL THEN 1.0 ELSE 0 END) AS original_price,
  avg(CASE WHEN coalesce(currency, '') <> '' THEN 1.0 ELSE 0 END) AS currency,
  avg(CASE WHEN rating IS NOT NULL THEN 1.0 ELSE 0 END) AS rating,
  avg(CASE WHEN review_count IS NOT NULL THEN 1.0 ELSE 0 END) AS review_count,
  avg(CASE WHEN coalesce(image_url, '') <> '' THEN 1.0 ELSE 0 END) AS image_url,
  avg(CASE WHEN coalesce(product_url, '') <> '' THEN 1.0 ELSE 0 END) AS product_url,
  avg(CASE WHEN description <> '' THEN 1.0 ELSE 0 END) AS description,
  1.0::DOUBLE AS attributes FROM products GROUP BY 1)
SELECT tenant, field, round(fraction, 6) AS fraction FROM wide
UNPIVOT (fraction FOR field IN (brand, category_path, price, original_price, currency, rating,
  review_count, image_url, product_url, description, attributes))""")
def agg_completeness(spark, sf):
    return plain(quality.completeness(st.products(spark, sf, reviews=True)))


def _summary_sql(source: str, key: str, value: str, picks: dict[str, float]) -> str:
    chosen = ", ".join(
        f"round(max(CASE WHEN rn - 1 = least(n - 1, greatest(0, CAST(round_even({p} * (n - 1), 0)"
        f" AS BIGINT))) THEN v END), 6) AS {name}" for name, p in picks.items())
    return f"""ranked AS (SELECT {key} AS k, CAST({value} AS DOUBLE) AS v,
    row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS rn,
    count({value}) OVER (PARTITION BY {key}) AS n FROM {source} WHERE {value} IS NOT NULL),
  picked AS (SELECT k, {chosen} FROM ranked GROUP BY 1)"""


@register("agg_numeric_summary", f"""{P_SQL},
{_summary_sql('products', 'tenant', 'price', quality.SUMMARY_QUANTILES)}
SELECT tenant, count(price) AS count, count(*) - count(price) AS null_count,
  round(CAST(min(price) AS DOUBLE), 6) AS min, p25, median, p75, p95,
  round(CAST(max(price) AS DOUBLE), 6) AS max, round(avg(CAST(price AS DOUBLE)), 6) AS mean
FROM products JOIN picked ON k = tenant GROUP BY tenant, p25, median, p75, p95""")
def agg_numeric_summary(spark, sf):
    return plain(quality.numeric_summary(st.products(spark, sf), "price"))


@register("agg_numeric_summary_lines", f"""WITH
{_summary_sql('lineitem', 'l_returnflag', 'l_extendedprice', quality.SUMMARY_QUANTILES)}
SELECT l_returnflag AS tenant, count(*) AS count, CAST(0 AS BIGINT) AS null_count,
  round(min(l_extendedprice), 6) AS min, p25, median, p75, p95,
  round(max(l_extendedprice), 6) AS max, round(avg(l_extendedprice), 4) AS mean
FROM lineitem JOIN picked ON k = l_returnflag GROUP BY l_returnflag, p25, median, p75, p95""")
def agg_numeric_summary_lines(spark, sf):
    """Groups large enough to go through the bracketed selection."""
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "tenant")
    summary = quality.numeric_summary(lines, "l_extendedprice")
    return plain(summary.withColumn("mean", F.round("mean", 4)))


DIVERSITY_SQL = """labels AS (SELECT tenant, array_to_string(category_path, ' > ') AS label,
    count(*) AS n, min(p_partkey) AS first_seq FROM products WHERE len(category_path) > 0
    GROUP BY 1, 2),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY n DESC, first_seq) AS rank,
    sum(n) OVER (PARTITION BY tenant) AS total FROM labels),
  diversity AS (SELECT tenant, CAST(max(total) AS BIGINT) AS products_with_category,
    count(*) AS distinct_categories, max(CASE WHEN rank = 1 THEN label END) AS top_label,
    max(CASE WHEN rank = 1 THEN n END) / max(total) AS top_share,
    sum(CAST(n AS DOUBLE) * n) / max(total) / max(total) AS hhi FROM ordered GROUP BY 1)"""


@register("agg_category_diversity", f"""{P_SQL}, {DIVERSITY_SQL}
SELECT tenant, products_with_category, distinct_categories, top_label,
  round(top_share, 6) AS top_share, round(hhi, 6) AS hhi FROM diversity""")
def agg_category_diversity(spark, sf):
    return plain(quality.category_diversity(st.products(spark, sf)))


@register("top_categories", f"""{P_SQL}, {DIVERSITY_SQL}
SELECT tenant, rank, label, n FROM ordered WHERE rank <= 5""")
def top_categories(spark, sf):
    return plain(quality.top_categories(st.products(spark, sf)))


@register("top_prices", f"""{P_SQL},
r AS (SELECT tenant, sku, price, row_number() OVER (PARTITION BY tenant
  ORDER BY price DESC, sku) AS rank FROM products WHERE price IS NOT NULL)
SELECT tenant, rank, sku, round(CAST(price AS DOUBLE), 6) AS price FROM r WHERE rank <= 3""")
def top_prices(spark, sf):
    return plain(quality.top_prices(st.products(spark, sf)))


RATES_SQL = f"""{fq.MAPPED_SQL},
rates AS (SELECT tenant, (count(*) FILTER (error_reason IS NULL) - count(DISTINCT CASE WHEN
    error_reason IS NULL THEN sku END)) / count(*) AS rate FROM judged GROUP BY 1)"""


@register("agg_duplicate_rate", f"""{RATES_SQL}
SELECT tenant, round(rate, 6) AS rate FROM rates""")
def agg_duplicate_rate(spark, sf):
    return plain(quality.duplicate_rates(delta.parse_stats(fq.mapped(spark, sf))))


@register("agg_grubbs", """WITH
rates AS (SELECT 's' || (user_id % 12) AS tenant,
    CASE WHEN user_id % 12 = 5 THEN 0.9 ELSE avg(value) / 1000 END AS rate
  FROM events GROUP BY ALL),
r AS (SELECT tenant, max(rate) AS rate FROM (SELECT 's' || (user_id % 12) AS tenant,
    CASE WHEN user_id % 12 = 5 THEN 0.9 ELSE value / 1000 END AS rate FROM events) GROUP BY 1),
s AS (SELECT avg(rate) AS m, stddev_pop(rate) AS sd, max(rate) AS top FROM r)
SELECT tenant, round(rate, 6) AS rate, round((rate - m) / sd, 6) AS g,
  CAST(2.412 AS DOUBLE) AS critical
FROM r, s WHERE rate = top AND (rate - m) / sd > 2.412""")
def agg_grubbs(spark, sf):
    k = F.col("user_id") % 12
    rates = table(spark, sf, "events").groupBy(
        F.concat(F.lit("s"), k.cast("string")).alias("tenant")).agg(
        F.max(F.when(k == 5, 0.9).otherwise(F.col("value") / 1000)).alias("rate"))
    return plain(quality.duplicate_outliers(rates))


REPORT_SQL = f"""{P_SQL}, {DIVERSITY_SQL},
{_summary_sql('products', 'tenant', 'price', {'p25': .25, 'p75': .75})},
limits AS (SELECT tenant, CAST(min(price) AS DOUBLE) AS lo, CAST(max(price) AS DOUBLE) AS hi,
  max(rating) AS rating_max, 1 - avg(CASE WHEN description <> '' THEN 1.0 ELSE 0 END) AS empty
  FROM products GROUP BY 1),
profile AS (SELECT * FROM limits JOIN diversity USING (tenant) JOIN picked ON k = tenant),
{fq.MAPPED_SQL.removeprefix('WITH ')},
failing AS (SELECT tenant, count(*) FILTER (error_reason IS NOT NULL) / count(*) AS rate
  FROM judged GROUP BY 1),
flags AS (
  SELECT tenant, 'warning' AS severity, 'parse_failures' AS rule, rate AS value FROM failing
    WHERE rate > 0.05
  UNION ALL SELECT tenant, 'warning', 'category_highly_concentrated', hhi FROM profile
    WHERE products_with_category >= 20 AND hhi > 0.25
  UNION ALL SELECT tenant, 'warning', 'category_moderately_concentrated', hhi FROM profile
    WHERE products_with_category >= 20 AND hhi > 0.15 AND hhi <= 0.25
  UNION ALL SELECT tenant, 'critical', 'price_not_positive', lo FROM profile WHERE lo <= 0
  UNION ALL SELECT tenant, 'warning', 'price_far_out', hi FROM profile WHERE p25 > 0
    AND p75 > p25 AND log10(hi) > log10(p75) + 3 * (log10(p75) - log10(p25))
  UNION ALL SELECT tenant, 'critical', 'rating_above_scale', rating_max FROM profile
    WHERE rating_max > 5
  UNION ALL SELECT tenant, 'warning', 'descriptions_missing', empty FROM profile
    WHERE empty > 0.5)"""


PEERS_SQL = """
  UNION ALL SELECT tenant, 'warning', 'duplicate_rate', rate FROM (
    SELECT tenant, rate, avg(rate) OVER () AS m, stddev_pop(rate) OVER () AS sd,
      max(rate) OVER () AS top FROM (
      SELECT tenant, (count(*) FILTER (error_reason IS NULL) - count(DISTINCT CASE WHEN
        error_reason IS NULL THEN sku END)) / count(*) AS rate FROM judged GROUP BY 1))
  WHERE rate = top AND (rate - m) / sd > 1.155"""


def _one_category(spark, sf):
    """The catalog with tenant t2 squeezed into one category and one wild price."""
    p = st.products(spark, sf, reviews=True)
    odd = F.col("tenant") == "t2"
    wild = F.col("sku") == "P-2"
    return p.withColumns({
        "category_path": F.when(odd, F.array(F.lit("ALL"))).otherwise(F.col("category_path")),
        "price": F.when(wild, F.lit(99999999).cast("decimal(18,4)")).otherwise(F.col("price")),
        "description": F.when(odd, "").otherwise(F.col("description"))})


ODD_SQL = REPORT_SQL.replace(
    "SELECT r.*, CASE WHEN cat1 IS NULL THEN [] ELSE [cat1, cat2] END AS category_path,",
    """SELECT r.* REPLACE (CASE WHEN sku = 'P-2' THEN 99999999 ELSE price END AS price,
      CASE WHEN tenant = 't2' THEN '' ELSE description END AS description),
    CASE WHEN tenant = 't2' THEN ['ALL'] WHEN cat1 IS NULL THEN [] ELSE [cat1, cat2] END
      AS category_path,""")


@register("dq_rules", f"""{ODD_SQL}
SELECT tenant, severity, rule, round(value, 6) AS value FROM flags""")
def dq_rules(spark, sf):
    stats = delta.parse_stats(fq.mapped(spark, sf))
    return plain(quality.rule_flags(quality.profile(_one_category(spark, sf), stats)))


@register("dq_report", f"""{REPORT_SQL}
SELECT tenant, severity, rule, round(value, 6) AS value FROM (SELECT * FROM flags {PEERS_SQL})""")
def dq_report(spark, sf):
    stats = delta.parse_stats(fq.mapped(spark, sf))
    return plain(quality.quality_report(st.products(spark, sf, reviews=True), stats))


@register("agg_severity_summary", f"""{ODD_SQL}
SELECT severity, count(*) AS n FROM (SELECT * FROM flags {PEERS_SQL}) GROUP BY 1""")
def agg_severity_summary(spark, sf):
    stats = delta.parse_stats(fq.mapped(spark, sf))
    return quality.severity_summary(quality.quality_report(_one_category(spark, sf), stats))


@register("even_sample", """WITH
r AS (SELECT o_orderpriority AS tenant, o_orderkey, row_number() OVER (
    PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS rn,
    count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders)
SELECT tenant, o_orderkey FROM r WHERE rn IN (
  SELECT CAST(floor(CAST(i AS DOUBLE) * (r.size / 20)) AS BIGINT) FROM range(20) t(i))""")
def even_sample(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tenant"),
                                               "o_orderkey")
    return quality.even_sample(orders, 20, ["tenant"], "o_orderkey",
                               F.floor(F.col("o_orderkey") / 1024)).select("tenant", "o_orderkey")


@register("stride_anchors", """WITH
r AS (SELECT o_orderpriority AS tenant, o_orderkey, row_number() OVER (
    PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders),
h AS (SELECT *, count(*) OVER (PARTITION BY tenant) AS size FROM r WHERE rn <= 500)
SELECT tenant, o_orderkey FROM h WHERE (rn - 1) % greatest(1, size // 4) = 0""")
def stride_anchors(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("tenant"),
                                               "o_orderkey")
    return quality.stride_anchors(orders, 4, 500, ["tenant"], "o_orderkey",
                                  F.floor(F.col("o_orderkey") / 1024)).select(
        "tenant", "o_orderkey")


# --- embeddings -----------------------------------------------------------------------

COMPONENTS_SQL = """components AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS at,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@register("cosine_similarity", """
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
  lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return plain(e.join(after, "vec_id").select("vec_id", cosine_similarity(
        F.col("embedding"), F.col("other")).alias("similarity")))


@register("pairwise_similarity", """
SELECT count(DISTINCT a.vec_id) + 1 AS n, round(avg(list_sum(list_transform(
  list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))), 6)
  AS mean_similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""")
def pairwise_similarity(spark, sf):
    return plain(embeddings.pairwise_similarity(table(spark, sf, "embeddings")))


@register("group_contrast", """WITH
p AS (SELECT a.label = b.label AS same, list_sum(list_transform(list_zip(a.embedding, b.embedding),
    lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT (SELECT count(DISTINCT label) FROM embeddings) AS groups_compared,
  count(*) FILTER (same) AS n_within_pairs, count(*) FILTER (NOT same) AS n_across_pairs,
  round(avg(s) FILTER (same), 6) AS within_mean, round(avg(s) FILTER (NOT same), 6) AS across_mean,
  round(avg(s) FILTER (same) - avg(s) FILTER (NOT same), 6) AS contrast FROM p""")
def group_contrast(spark, sf):
    return plain(embeddings.group_contrast(table(spark, sf, "embeddings"), F.col("label")))


KNN_SQL = """pairs AS (
  SELECT 'v' || (a.vec_id % 2) AS tenant, a.vec_id AS q, b.vec_id AS d,
    round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
      lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = b.vec_id % 2 AND a.vec_id <> b.vec_id)"""


@register("knn_topk", f"""WITH {KNN_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, CAST(d AS VARCHAR)) AS rank
  FROM pairs)
SELECT tenant, CAST(q AS VARCHAR) AS qid, CAST(d AS VARCHAR) AS id, round(s, 6) AS score, rank
FROM r WHERE rank <= 5""")
def knn_topk(spark, sf):
    v = st.vectors(spark, sf)
    corpus = v.select("tenant", "id", F.col("embedding").alias("v"))
    return plain(embeddings.knn_topk(corpus.withColumnRenamed("id", "qid"), corpus, 5,
                                     exclude_self=True))


@register("probe_queries", """WITH
probes AS (SELECT label, 'v' || (vec_id % 2) AS tenant, min(vec_id) AS pid FROM embeddings
  GROUP BY 1, 2),
pairs AS (SELECT p.tenant, p.pid, b.vec_id AS d, round(list_sum(list_transform(
    list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9)
    AS s
  FROM probes p JOIN embeddings a ON a.vec_id = p.pid
  JOIN embeddings b ON b.vec_id % 2 = p.pid % 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s DESC, CAST(d AS VARCHAR)) AS rank
  FROM pairs)
SELECT CAST(pid AS VARCHAR) AS qid, CAST(d AS VARCHAR) AS id, rank FROM r WHERE rank <= 3""")
def probe_queries(spark, sf):
    v = st.vectors(spark, sf)
    probes = v.groupBy("label", "tenant").agg(F.min_by("id", "vec_id").alias("qid"),
                                              F.min_by("embedding", "vec_id").alias("v"))
    corpus = v.select("tenant", "id", F.col("embedding").alias("v"))
    return plain(embeddings.knn_topk(probes, corpus, 3).select("qid", "id", "rank"))


# --- enrichment -----------------------------------------------------------------------

@register("taxonomy_values", """
SELECT p_brand AS tenant, array_to_string(list_sort(list_distinct(list(n))), '|')
  AS category_values
FROM (SELECT p_brand, unnest([p_type, split_part(p_name, ' ', 2)]) AS n FROM part) GROUP BY 1""")
def taxonomy_values(spark, sf):
    leaves = table(spark, sf, "part").select(
        F.col("p_brand").alias("tenant"),
        F.concat("p_type", F.lit(" > "), F.split_part("p_name", F.lit(" "), F.lit(2)))
        .alias("leaf"))
    return plain(enrich.taxonomy_values(leaves))


@register("keyword_bucket", r"""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)\b(widget|bolt)\b') THEN 'hardware'
  WHEN regexp_matches(p_name, '(?i)\b(small|ring)\b') THEN 'jewel' END AS bucket FROM part""")
def keyword_bucket(spark, sf):
    words = {"hardware": r"(?i)\b(widget|bolt)\b", "jewel": r"(?i)\b(small|ring)\b"}
    return table(spark, sf, "part").select("p_partkey", enrich.keyword_bucket(
        F.col("p_name"), words).alias("bucket"))


@register("group_key_for", f"""{P_SQL}
SELECT sku, CASE tenant WHEN 't0' THEN brand WHEN 't1' THEN category_path[1]
  ELSE CASE WHEN p_partkey % 2 = 0 THEN 'phone' ELSE 'computer' END END AS grp FROM products""")
def group_key_for(spark, sf):
    p = st.products(spark, sf)
    even = F.substring("sku", 3, 20).cast("long") % 2 == 0
    titled = p.withColumn("title", F.when(even, "a phone with camera").otherwise("Mouse pad"))
    kind = (F.when(F.col("tenant") == "t0", "fashion").when(F.col("tenant") == "t1", "home")
            .otherwise("electronics"))
    return titled.select("sku", enrich.group_key(kind).alias("grp"))


def _items(spark, sf, by_title):
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    key = F.col("p_name") if by_title else F.concat(F.lit("K"), (k % 400).cast("string"))
    rows = part.select(
        F.concat(F.lit("t"), (k % 3).cast("string")).alias("tenant"),
        F.when(k % 50 == 0, "").otherwise(key).alias("key"), F.col("p_name").alias("title"),
        F.repeat(F.concat("p_type", F.lit(" ")), 30).alias("description"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("in "), F.col("p_brand"))).alias("hint"),
        k.alias("feed_seq"))
    return enrich.work_items(rows, by_title)


def _items_sql(by_title: bool) -> str:
    key = "p_name" if by_title else "'K' || (p_partkey % 400)"
    pick = "arg_min" if by_title else "arg_max"
    return f"""items AS (SELECT 't' || (p_partkey % 3) AS tenant, {key} AS key,
    {pick}(p_name, p_partkey) AS title,
    {pick}(substr(repeat(p_type || ' ', 30), 1, 150), p_partkey) AS description,
    {pick}(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END, p_partkey) AS hint0,
    min(p_partkey) AS first_seq FROM part WHERE p_partkey % 50 <> 0 GROUP BY 1, 2)"""


@register("enrich_work_items_title", f"""WITH {_items_sql(True)}
SELECT tenant, key, title, description, nullif(hint0, '') AS hint, first_seq FROM items""")
def enrich_work_items_title(spark, sf):
    return _items(spark, sf, True)


@register("enrich_work_items", f"""WITH {_items_sql(False)}
SELECT tenant, key, title, description, nullif(hint0, '') AS hint, first_seq FROM items""")
def enrich_work_items(spark, sf):
    return _items(spark, sf, False)


@register("except_done", f"""WITH {_items_sql(False)}
SELECT tenant, key FROM items WHERE key NOT IN (
  SELECT 'K' || (s_suppkey % 400) FROM supplier)""")
def except_done(spark, sf):
    done = table(spark, sf, "supplier").select(
        F.concat(F.lit("K"), (F.col("s_suppkey") % 400).cast("string")).alias("key"))
    return enrich.not_done(_items(spark, sf, False), done).select("tenant", "key")


@register("pilot_limit", f"""WITH {_items_sql(False)},
r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY first_seq) AS rn FROM items)
SELECT tenant, key FROM r WHERE rn <= 100""")
def pilot_limit(spark, sf):
    return enrich.pilot(_items(spark, sf, False), 100).select("tenant", "key")


BATCH_SQL = f"""WITH {_items_sql(False)},
r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY first_seq) - 1 AS i FROM items)"""


def _batches(spark, sf):
    return enrich.number_batches(_items(spark, sf, False), F.floor(F.col("first_seq") / 128))


@register("batch_number", f"""{BATCH_SQL}
SELECT tenant, key, i // 40 AS batch, i % 40 AS slot FROM r""")
def batch_number(spark, sf):
    return plain(_batches(spark, sf).select("tenant", "key", "batch", "slot"))


@register("template_work_item", f"""{BATCH_SQL}
SELECT tenant, i // 40 AS batch, (i % 40) || '. ' || title || ' (description: ' || description
  || ')' || CASE WHEN hint0 = '' THEN '' ELSE ' (scraper category hint: ' || hint0 || ')' END
  AS line FROM r""")
def template_work_item(spark, sf):
    return _batches(spark, sf).select("tenant", "batch", enrich.work_line().alias("line"))


LEAVES_SQL = """leaves AS (SELECT DISTINCT 't' || (p_partkey % 3) AS tenant,
    p_type || ' > ' || split_part(p_name, ' ', 2) AS leaf FROM part),
  taxonomy AS (SELECT tenant, leaf, row_number() OVER (PARTITION BY tenant ORDER BY leaf) AS position
    FROM leaves)"""


def _taxonomy(spark, sf):
    """A closed label set per tenant (types by nouns: some dozens, whatever the catalog size)."""
    k = F.col("p_partkey")
    leaves = table(spark, sf, "part").select(
        F.concat(F.lit("t"), (k % 3).cast("string")).alias("tenant"), F.concat(
            "p_type", F.lit(" > "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("leaf"))
    return leaves.distinct().withColumn("position", F.rank().over(
        W.partitionBy("tenant").orderBy("leaf")))


@register("enrich_classify", f"""WITH {_items_sql(False)}, {LEAVES_SQL},
words AS (SELECT i.tenant, key, list_distinct(list_filter(string_split_regex(lower(title || ' ' ||
    description || coalesce(' ' || nullif(hint0, ''), '')), '[^a-z0-9]+'), lambda w: w <> '')) AS w
  FROM items i),
scored AS (SELECT words.tenant, key, leaf, position, len(list_intersect(w, list_distinct(
    string_split_regex(lower(leaf), '[^a-z0-9]+')))) AS score
  FROM words JOIN taxonomy USING (tenant)),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant, key ORDER BY score DESC, position) AS rn
  FROM scored)
SELECT tenant, key, CASE WHEN score > 0 THEN leaf ELSE 'Other > Uncategorized' END AS label
FROM r WHERE rn = 1""")
def enrich_classify(spark, sf):
    return enrich.classify(_items(spark, sf, False), _taxonomy(spark, sf))


@register("enrich_validate", f"""WITH {LEAVES_SQL},
proposed AS (SELECT 't' || (p_partkey % 3) AS tenant, 'P-' || p_partkey AS key,
  CASE p_partkey % 3 WHEN 0 THEN p_type || ' > ' || split_part(p_name, ' ', 2)
    WHEN 1 THEN 'Invented > ' || p_type END AS label FROM part)
SELECT p.tenant, key, coalesce(leaf, 'Other > Uncategorized') AS label
FROM proposed p LEFT JOIN taxonomy t ON t.tenant = p.tenant AND leaf = label""")
def enrich_validate(spark, sf):
    k = F.col("p_partkey")
    proposed = table(spark, sf, "part").select(
        F.concat(F.lit("t"), (k % 3).cast("string")).alias("tenant"),
        F.concat(F.lit("P-"), k.cast("string")).alias("key"),
        F.when(k % 3 == 0, F.concat("p_type", F.lit(" > "), F.split_part(
            "p_name", F.lit(" "), F.lit(2)))).when(
            k % 3 == 1, F.concat(F.lit("Invented > "), F.col("p_type"))).alias("label"))
    return enrich.validate_labels(proposed, _taxonomy(spark, sf))


@register("agg_enrich_cost", f"""WITH {st.USAGE_SQL}
SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  round(CAST(sum(cost_usd) AS DOUBLE), 6) AS cost_usd, (SELECT count(*) FROM part) AS n_items,
  round(CAST(sum(cost_usd) AS DOUBLE) / (SELECT count(*) FROM part), 6) AS cost_per_item
FROM usage""")
def agg_enrich_cost(spark, sf):
    return plain(enrich_cost(with_cost(st.usage(spark, sf)), table(spark, sf, "part")))


@register("join_pairs", """
SELECT CAST(a.label AS VARCHAR) AS grp, count(*) AS n_pairs, round(avg(list_sum(list_transform(
  list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))), 6)
  AS mean_similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def join_pairs(spark, sf):
    """Pairs i < j within each group, counted and averaged without forming them."""
    sums = embeddings.vector_sums(table(spark, sf, "embeddings"), F.col("label"))
    n = F.col("n")
    pairs = n * (n - 1) / 2
    return plain(sums.where(n > 1).select(
        "grp", pairs.cast("long").alias("n_pairs"),
        ((F.col("norm2") - F.col("squares")) / 2 / pairs).alias("mean_similarity")))


@register("join_lookup_enrichment", f"""WITH {st.PRODUCTS_SQL.strip()}, {fq.LABELS_SQL}
SELECT tenant, coalesce(label, 'Other > Uncategorized') AS display_category, count(*) AS n
FROM products LEFT JOIN labels_by_name ON key = title GROUP BY 1, 2""")
def join_lookup_enrichment(spark, sf):
    labelled = fm.enrich_category(st.products(spark, sf), fq.name_labels(spark, sf),
                                  F.col("title"))
    return labelled.groupBy("tenant", "display_category").agg(F.count("*").alias("n"))
