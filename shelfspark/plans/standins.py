"""Catalog-shaped views of the given tables.

The row expressions are written in the SQL that Spark and the checking engine share, so a
query and its check start from the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.routing import ATTRIBUTE, EXPLORATORY, IDENTIFIER
from shelfspark.plans.registry import table
from shelfspark.session import materialise
from shelfspark.sources.feeds import widen

PRODUCT_ROWS = """
SELECT concat('t', CAST(p_partkey % 3 AS STRING)) AS tenant,
  concat('P-', CAST(p_partkey AS STRING)) AS sku,
  p_name AS title,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(p_brand, ' ', lower(p_type), ' ', p_name) END
    AS description,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS brand,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS cat1,
  split_part(p_name, ' ', 2) AS cat2,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,4)) END AS price,
  CASE WHEN p_partkey % 3 = 0 THEN 'INR' WHEN p_partkey % 3 = 1 THEN 'USD' ELSE NULL END
    AS currency,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(p_retailprice * 2 AS DECIMAL(18,4)) ELSE NULL END
    AS original_price,
  p_size % 5 <> 0 AS in_stock,
  CASE WHEN p_partkey % 6 = 0 THEN NULL
       ELSE concat('http://img.example/', CAST(p_partkey AS STRING)) END AS image_url,
  concat('http://shop.example/p/', CAST(p_partkey AS STRING)) AS product_url,
  CASE p_size % 3 WHEN 0 THEN 'Men' WHEN 1 THEN 'Women' ELSE NULL END AS gender,
  split_part(p_name, ' ', 1) AS colour,
  p_partkey, p_partkey AS feed_seq
FROM {part}
"""

RATINGS = """
SELECT l_partkey, count(*) AS review_count,
  floor(5000.0 - 50.0 * sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*)) / 1000.0
    AS rating
FROM {lineitem} GROUP BY l_partkey
"""

FEED_COLUMNS = """
  concat('t', CAST(p_partkey % 3 AS STRING)) AS tenant,
  CASE WHEN p_partkey % 17 = 0 THEN '  '
       ELSE concat(' P-', CAST(p_partkey AS STRING), ' ') END AS id,
  CASE WHEN p_partkey % 19 = 0 THEN '' ELSE concat(p_name, '  ', lower(p_type)) END AS name,
  concat(p_brand, chr(10), ' made  of ', p_type) AS descr,
  p_brand AS maker,
  CASE p_partkey % 4 WHEN 0 THEN concat(p_type, ' >> ', p_brand)
    WHEN 1 THEN concat(p_type, '/', p_brand, '/ ') WHEN 2 THEN p_type ELSE '' END AS cat,
  CASE p_partkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'no' WHEN 2 THEN 'In  Stock'
    WHEN 3 THEN 'sold out' ELSE 'maybe' END AS stock,
  CASE p_partkey % 5 WHEN 0 THEN '4.5' WHEN 1 THEN '9/10' WHEN 2 THEN '4,2' WHEN 3 THEN '4/0'
    ELSE 'n/a' END AS stars,
  CASE WHEN p_partkey % 23 = 0 THEN '-3' WHEN p_partkey % 3 = 0 THEN '1,234 reviews'
    WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS STRING) ELSE '' END AS reviews,
  split_part(p_name, ' ', 1) AS colour,
  CASE p_size % 3 WHEN 0 THEN ' Men' WHEN 1 THEN 'Women' ELSE '' END AS gender
"""

FEED_ROWS = """
SELECT p_partkey AS feed_seq,
  CASE p_partkey % 6 WHEN 0 THEN concat('Rs. 1,', whole, '.00')
    WHEN 1 THEN concat('1.', whole, ',50') WHEN 2 THEN concat(whole, '/-')
    WHEN 3 THEN concat('$', whole, '.99') WHEN 4 THEN 'N/A'
    ELSE concat(whole, ' (25% off)') END AS mrp, """ + FEED_COLUMNS + """
FROM (SELECT *, CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) AS whole FROM {part}) a
UNION ALL
SELECT p_partkey + 1000000000 AS feed_seq, concat('$', whole, '.49') AS mrp, """ + FEED_COLUMNS + """
FROM (SELECT *, CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) AS whole FROM {part}) b
WHERE p_partkey % 10 = 0
"""

USAGE_ROWS = """
SELECT event_id, CAST(user_id % 3 AS STRING) AS merchant,
  CASE WHEN event_type IN ('click', 'view') THEN 'fast' ELSE 'reasoning' END AS model,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS output_tokens,
  user_id AS cache_read_tokens, event_id % 7 AS cache_write_tokens, ts AS created_at
FROM {events}
"""

GOLDEN_TENANTS = ("en", "fr", "de", "es")
ANCHOR_WORDS = 3
#: Passages that are searched for in one pass.
PASSAGES = 50_000


def rows(spark: SparkSession, sf: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf, name) for name in names})


def wide(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return widen(table(spark, sf, name))


def products(spark: SparkSession, sf: str, reviews: bool = False) -> DataFrame:
    """The catalog; ratings and review counts only when asked for (they read lineitem)."""
    base = spark.sql(PRODUCT_ROWS, part=wide(spark, sf, "part"))
    if reviews:
        rated = rows(spark, sf, RATINGS, "lineitem")
        base = base.join(rated, base.p_partkey == rated.l_partkey, "left").drop("l_partkey")
    else:
        base = base.withColumns({"rating": F.lit(None).cast("double"),
                                 "review_count": F.lit(None).cast("long")})
    return base.withColumns({
        "category_path": F.when(F.col("cat1").isNull(), F.array().cast("array<string>"))
                          .otherwise(F.array("cat1", "cat2")),
        "attributes": F.map_filter(F.create_map(F.lit("gender"), F.col("gender"),
                                                F.lit("colour"), F.col("colour")),
                                   lambda _, v: v.isNotNull()),
    }).drop("cat1", "cat2", "colour", "p_partkey")


def messy_feed(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf, FEED_ROWS, "part")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf, USAGE_ROWS, "events")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Text corpus as a searchable catalog: tenant is the language."""
    return wide(spark, sf, "documents").select(
        F.col("lang").alias("tenant"), F.concat(F.lit("D"), F.col("doc_id").cast("string"))
        .alias("sku"), "text")


def golden_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The words of every benchmark passage, asked in every tenant.

    A third each as they are, as a wish and with a product code; ``label`` is the class that this
    shape was made for.
    """
    words = F.filter(F.split(F.col("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    asked, third = F.array_join(words, " "), F.col("item_id") % 3
    shaped = F.when(third == 1, F.concat(F.lit("something for "), asked)).when(
        third == 2, F.concat(asked, F.lit(" AB-12"), F.col("item_id").cast("string"))
        ).otherwise(asked)
    label = F.when(third == 1, EXPLORATORY).when(third == 2, IDENTIFIER).otherwise(ATTRIBUTE)
    return table(spark, sf, "benchmark").select(
        "item_id", shaped.alias("query"), label.alias("label"), F.col("text").alias("passage"),
        F.explode(F.array(*map(F.lit, GOLDEN_TENANTS))).alias("tenant")).withColumn(
        "qid", F.concat("tenant", F.lit("-"), F.col("item_id").cast("string")))


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    """rel 2 for each document holding a query's passage.

    A passage's inner words stand alone in any text that holds it, so a text is searched for passages
    whose first inner words, three at most, it holds in a row. Passages of one or two words have no
    inner word and are tested directly. Passages go to all tasks, a bounded number in each pass.
    """
    passages = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage")).where(
        F.col("passage").isNotNull())
    passes = max(1, -(-passages.count() // PASSAGES))
    texts = docs(spark, sf)
    found = reduce(DataFrame.unionByName, [
        _holding(texts, passages.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)) for i in range(passes)])
    asked = golden_queries(spark, sf).select("qid", "tenant", "item_id")
    # Read twice by every metric: the texts are searched once.
    return materialise(found.join(asked, ["tenant", "item_id"]).select(
        "qid", "tenant", "sku", F.lit(2).alias("rel")).distinct())


def _holding(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(tenant, sku, item_id) of texts and the passages they hold."""
    anchored: dict[int, dict[tuple, list]] = {}
    short = []
    for item, passage in passages.collect():
        words = passage.split()
        n = min(ANCHOR_WORDS, len(words) - 2)
        if n > 0:
            anchored.setdefault(n, {}).setdefault(tuple(words[1:1 + n]), []).append((item, passage))
        else:
            short.append((item, passage))
    shared = texts.sparkSession.sparkContext.broadcast((anchored, short))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length, always = shared.value
        for batch in batches:
            rows, items = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                if text is None:
                    continue
                words = text.split()
                maybe = list(always)
                for n, anchors in by_length.items():
                    for run in set(filter(anchors.__contains__, zip(*[words[i:] for i in range(n)]))):
                        maybe += anchors[run]
                held = [item for item, passage in maybe if passage in text]
                rows += [row] * len(held)
                items += held
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(items, pa.int64())],
                ["tenant", "sku", "item_id"])

    return texts.select("tenant", "sku", "text").mapInArrow(find, "tenant string, sku string, item_id long")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), (F.col("vec_id") % 2).cast("string")).alias("tenant"),
        F.col("vec_id").cast("string").alias("id"), "vec_id", "embedding", "label")


# The same rows for the checking engine.
def _duck(sql: str) -> str:
    for name in ("part", "lineitem", "events"):
        sql = sql.replace("{" + name + "}", name)
    return sql.strip()


PRODUCTS_SQL = f"""
product_rows AS ({_duck(PRODUCT_ROWS)}),
ratings AS ({_duck(RATINGS)}),
products AS (
  SELECT r.*, CASE WHEN cat1 IS NULL THEN [] ELSE [cat1, cat2] END AS category_path,
    rating, review_count
  FROM product_rows r LEFT JOIN ratings ON p_partkey = l_partkey)"""

FEED_SQL = f"feed AS ({_duck(FEED_ROWS)})"
USAGE_SQL = f"""
usage_rows AS ({_duck(USAGE_ROWS)}),
prices(model, pin, pout) AS (VALUES ('fast', 1.00, 5.00), ('reasoning', 2.00, 10.00)),
usage AS (
  SELECT u.*, CAST((CAST(input_tokens AS DECIMAL(18,4)) * pin
      + CAST(output_tokens AS DECIMAL(18,4)) * pout
      + CAST(cache_read_tokens AS DECIMAL(18,4)) * pin * 0.1
      + CAST(cache_write_tokens AS DECIMAL(18,4)) * pin * 1.25) / 1000000 AS DECIMAL(14,8))
    AS cost_usd
  FROM usage_rows u JOIN prices USING (model))"""

DOCS_SQL = r"""
docs AS (
  SELECT lang AS tenant, 'D' || doc_id AS sku, text,
    list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS toks
  FROM documents)"""

GOLDEN_SQL = r"""
golden AS (
  SELECT t.tenant || '-' || item_id AS qid, t.tenant, text AS passage,
    CASE item_id % 3 WHEN 1 THEN 'something for ' ELSE '' END
      || array_to_string(list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'),
                                lambda w: w <> ''), ' ')
      || CASE item_id % 3 WHEN 2 THEN ' AB-12' || item_id ELSE '' END AS query
  FROM benchmark, (VALUES ('en'), ('fr'), ('de'), ('es')) t(tenant)),
judgments AS (
  SELECT qid, g.tenant, 'D' || doc_id AS sku, 2 AS rel
  FROM golden g JOIN documents d ON d.lang = g.tenant AND contains(d.text, g.passage))"""

LABELS_SQL = """
labelled AS (
  SELECT t.tenant || '-' || item_id AS qid, CASE item_id % 3 WHEN 1 THEN 'exploratory'
    WHEN 2 THEN 'identifier' ELSE 'attribute' END AS query_class
  FROM benchmark, (VALUES ('en'), ('fr'), ('de'), ('es')) t(tenant))"""
