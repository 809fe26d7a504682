"""Retrieval over the stored catalog: ingest, index, search, and the comparison of engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import evaluation as ev
from shelfspark.operators import pivot_index, retrievers, sparse_embed, text_index
from shelfspark.operators import search as hs
from shelfspark.plans import feed_queries as fq
from shelfspark.plans import standins as st
from shelfspark.plans.quality_queries import KNN_SQL
from shelfspark.plans.registry import register, table
from shelfspark.plans.shapes import plain
from shelfspark.session import scratch_path
from shelfspark.sources.catalog import CatalogTable
from shelfspark.streaming import runs

INSTRUCTION = "find: "


def _vectors(mark: str, prefix: str = "") -> str:
    """The vectors of the queries, with the words of a prefix, and their products with all products."""
    words = "query" if not prefix else "'" + prefix.strip(": ") + " ' || query"
    return f"""qcount{mark} AS (SELECT qid, tenant, ('0x' || substr(md5(term), 1, 8))::UBIGINT % 64 AS b,
    CAST(count(*) AS DOUBLE) AS c
  FROM (SELECT qid, tenant, unnest(string_split({words}, ' ')) AS term FROM golden) GROUP BY ALL),
qvec{mark} AS (SELECT qid, tenant, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY qid))
  AS FLOAT) AS DOUBLE) AS x FROM qcount{mark}),
near{mark} AS (SELECT qid, d.tenant, sku, sum(q.x * d.x) AS s FROM qvec{mark} q JOIN dvec d
  ON d.tenant = q.tenant AND d.b = q.b GROUP BY ALL),
vec{mark} AS (SELECT g.qid, d.tenant, d.sku, round(coalesce(s, 0.0), 9) AS score
  FROM golden g JOIN docs d ON d.tenant = g.tenant
  LEFT JOIN near{mark} n ON n.qid = g.qid AND n.sku = d.sku)"""


#: The stored products with the tokens of their five keyword fields; every kind of part is asked
#: for in every tenant.
STORED_SQL = rf"""{fq.MAPPED_SQL},
docs AS (
  SELECT tenant, sku, list_filter(string_split_regex(lower(concat_ws(' ', sku, title, description,
      brand, 'colour ' || colour, 'gender ' || gender)), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS toks,
    list_filter(string_split_regex(lower(concat_ws(' ', title, description, brand,
      'colour ' || colour, 'gender ' || gender)), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS vtoks,
    lower(concat_ws(' ', sku, title, description, brand, concat_ws(chr(10), 'colour: ' || colour,
      'gender: ' || gender))) AS low
  FROM deduped),
golden AS (
  SELECT DISTINCT t.tenant || '-' || p_type AS qid, t.tenant, lower(p_type) AS query, p_type
  FROM part, (VALUES ('t0'), ('t1'), ('t2')) t(tenant)),
judgments AS (
  SELECT qid, g.tenant, 'P-' || p_partkey AS sku, 2 AS rel FROM golden g JOIN part p
  ON p.p_type = g.p_type AND 't' || (p_partkey % 3) = g.tenant),
occ AS (SELECT tenant, sku, len(toks) AS dl, unnest(toks) AS term FROM docs),
tf AS (SELECT tenant, sku, dl, term, count(*) AS tf FROM occ GROUP BY ALL),
stats AS (SELECT tenant, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM docs GROUP BY 1),
qterms AS (SELECT DISTINCT qid, tenant, unnest(string_split(query, ' ')) AS term FROM golden),
df AS (SELECT tenant, term, count(*) AS df FROM tf GROUP BY 1, 2),
kw AS (
  SELECT tf.tenant, qid, sku, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qterms JOIN tf USING (tenant, term) JOIN df USING (tenant, term) JOIN stats USING (tenant)
  GROUP BY ALL),
vocc AS (SELECT tenant, sku, ('0x' || substr(md5(term), 1, 8))::UBIGINT % 64 AS b
  FROM (SELECT tenant, sku, unnest(vtoks) AS term FROM docs)),
vcount AS (SELECT tenant, sku, b, CAST(count(*) AS DOUBLE) AS c FROM vocc GROUP BY ALL),
dvec AS (SELECT tenant, sku, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY tenant, sku))
  AS FLOAT) AS DOUBLE) AS x FROM vcount),
{_vectors('')},
kwtop AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku) AS r FROM kw
  QUALIFY r <= 50),
vectop AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku) AS r FROM vec
  QUALIFY r <= 50),
kws AS (SELECT qid, tenant, sku, CASE WHEN max(score) OVER w > min(score) OVER w
    THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS kw
  FROM kwtop WINDOW w AS (PARTITION BY qid)),
vecs AS (SELECT qid, tenant, sku, CASE WHEN max(score) OVER w > min(score) OVER w
    THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS vec
  FROM vectop WINDOW w AS (PARTITION BY qid)),
fused AS (SELECT qid, tenant, sku, round(0.5 * coalesce(vec, 0.0) + 0.5 * coalesce(kw, 0.0), 9) AS score
  FROM kws FULL JOIN vecs USING (qid, tenant, sku)),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku) AS rank FROM fused)"""

OPTIONS = {"dynamic": False, "rerank_default": False}


def stored_catalog(spark: SparkSession, sf: str) -> CatalogTable:
    """The messy feed, ingested into an indexed catalog."""
    store = CatalogTable(spark, scratch_path(spark, "catalog"), indexed=True)
    runs.ingest_batch(st.messy_feed(spark, sf), store, fq.MAPPING)
    return store


def kind_queries(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "part").select("p_type").distinct()
    return kinds.select("p_type", F.explode(F.array(*map(F.lit, ("t0", "t1", "t2")))).alias("tenant")).select(
        F.concat_ws("-", "tenant", "p_type").alias("qid"), "tenant", F.lower("p_type").alias("query"))


def kind_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """rel 2 for the products of the kind that was asked for."""
    tenant = F.concat(F.lit("t"), (F.col("p_partkey") % 3).cast("string"))
    return table(spark, sf, "part").select(
        F.concat_ws("-", tenant, "p_type").alias("qid"), tenant.alias("tenant"),
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("sku"), F.lit(2).alias("rel"))


@register("catalog_bm25_preview", f"""{STORED_SQL}
SELECT qid, sku, r AS rank, round(score, 6) AS score FROM kwtop WHERE r <= 10""")
def catalog_bm25_preview(spark, sf):
    """Ten best products of every query from the stored index."""
    store = stored_catalog(spark, sf)
    found = text_index.top_documents(kind_queries(spark, sf), store.index(), 10)
    return plain(found.select("qid", "sku", "rank", "score"))


@register("catalog_search", f"""{STORED_SQL}
SELECT qid, tenant, sku, rank, round(score, 5) AS score FROM hybrid WHERE rank <= 10""")
def catalog_search(spark, sf):
    """Hybrid search over the stored catalog: neither tokens nor embeddings of products are made."""
    store = stored_catalog(spark, sf)
    asked = kind_queries(spark, sf).withColumn("alpha", F.lit(0.5))
    found = hs.search_catalog(asked, store, **OPTIONS)
    return found.select("qid", "tenant", "sku", F.col("rank").cast("long").alias("rank"),
                        F.round("score", 5).alias("score"))


COMPARED = ("ndcg_10", "recall_10", "mrr")


@register("retriever_comparison", f"""{STORED_SQL},
ranked AS (
  SELECT 'hybrid' AS engine, qid, sku, rank FROM hybrid WHERE rank <= 50
  UNION ALL SELECT 'pivot', qid, sku, r FROM vectop),
ideal AS (SELECT qid, count(*) AS n_rel, sum(CASE WHEN i <= 10 THEN 3 / log2(i + 1) END) AS idcg
  FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sku) AS i FROM judgments) GROUP BY 1),
found AS (SELECT engine, qid, sum(3 / log2(rank + 1)) FILTER (rank <= 10) AS dcg,
    count(*) FILTER (rank <= 10) AS hits, min(rank) AS first
  FROM ranked JOIN judgments USING (qid, sku) GROUP BY ALL),
scores AS (SELECT engine, coalesce(dcg, 0) / idcg AS ndcg_10, coalesce(hits, 0) / n_rel AS recall_10,
    coalesce(1 / first, 0) AS mrr
  FROM ideal CROSS JOIN (SELECT DISTINCT engine FROM ranked) LEFT JOIN found USING (engine, qid)),
exact AS (SELECT engine, count(*) FILTER (v.sku IS NOT NULL) / count(*) AS of_exact
  FROM ranked LEFT JOIN vectop v USING (qid, sku) WHERE rank <= 10 AND engine = 'pivot' GROUP BY 1)
SELECT engine, round(avg(ndcg_10), 4) AS ndcg_10, round(avg(recall_10), 4) AS recall_10,
  round(avg(mrr), 4) AS mrr, any_value(of_exact) >= 0.9 AS finds_exact
FROM scores LEFT JOIN exact USING (engine) GROUP BY 1""")
def retriever_comparison(spark, sf):
    """Two engines on one golden set; for the vector engine also whether exact search agrees."""
    store = stored_catalog(spark, sf)
    asked = kind_queries(spark, sf)
    engines = [retrievers.HybridRetriever(options=OPTIONS), retrievers.PivotRetriever()]
    found = retrievers.rankings(engines, asked.withColumn("alpha", F.lit(0.5)), store)
    scores = ev.score_queries(asked.select("qid", "tenant"), found, kind_judgments(spark, sf), by=["engine"])
    means = scores.groupBy("engine").agg(*[F.round(F.avg(m), 4).alias(m) for m in COMPARED])
    # Exact search over the same stored vectors.
    embed = hs.hashed_embedder()
    exact = hs.vector_search(asked.withColumn("embedding", embed("query")),
                             store.scan(columns=["tenant", "sku", "embedding"]), 10)
    agreed = (found.where("engine = 'pivot' AND rank <= 10")
              .join(exact.select("qid", "sku", F.lit(1).alias("hit")), ["qid", "sku"], "left")
              .groupBy("engine").agg((F.count("hit") >= 0.9 * F.count("*")).alias("finds_exact")))
    return means.join(agreed, "engine", "left")


def _lift_sql(after: str, before: str) -> str:
    """Means of every metric over two rankings (qid, sku, rank), and their differences query by query."""
    return f"""passes AS (SELECT true AS changed, qid, sku, rank FROM {after}
  UNION ALL SELECT false, qid, sku, rank FROM {before}),
ideal AS (SELECT qid, count(*) AS n_rel, sum(CASE WHEN i <= 10 THEN 3 / log2(i + 1) END) AS idcg
  FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sku) AS i FROM judgments) GROUP BY 1),
found AS (SELECT changed, qid, sum(3 / log2(rank + 1)) FILTER (rank <= 10) AS dcg,
    count(*) FILTER (rank <= 10) AS hits, min(rank) AS first
  FROM passes JOIN judgments USING (qid, sku) GROUP BY ALL),
scores AS (SELECT changed, qid, coalesce(dcg, 0) / idcg AS ndcg_10, coalesce(hits, 0) / n_rel AS recall_10,
    CAST(coalesce(1 / first, 0) AS DOUBLE) AS mrr
  FROM ideal CROSS JOIN (VALUES (true), (false)) c(changed) LEFT JOIN found USING (changed, qid)),
long AS (SELECT * FROM scores UNPIVOT (value FOR metric IN (ndcg_10, recall_10, mrr))),
pairs AS (SELECT metric, qid, max(value) FILTER (changed) AS after, max(value) FILTER (NOT changed) AS before
  FROM long GROUP BY ALL)
SELECT metric, round(avg(after), 5) AS after, round(avg(before), 5) AS before,
  round(avg(after - before), 5) AS lift, count(*) FILTER (round(after - before, 9) > 0) AS better,
  count(*) FILTER (round(after - before, 9) < 0) AS worse FROM pairs GROUP BY 1"""


def _told(lift: DataFrame) -> DataFrame:
    return lift.select("metric", *[F.round(c, 5).alias(c) for c in ("after", "before", "lift")], "better", "worse")


@register("rerank_lift", f"""{STORED_SQL},
pool AS (SELECT * FROM hybrid WHERE rank <= 50),
reranked AS (SELECT qid, sku, row_number() OVER (PARTITION BY qid ORDER BY points DESC, before) AS rank
  FROM (SELECT p.qid, p.sku, p.rank AS before, round(
      len(list_intersect(list_distinct(string_split(query, ' ')), toks))
        / len(list_distinct(string_split(query, ' ')))
      + CASE WHEN contains(low, query) THEN 0.5 ELSE 0.0 END, 9) AS points
    FROM pool p JOIN golden g USING (qid) JOIN docs d ON d.tenant = p.tenant AND d.sku = p.sku)),
{_lift_sql('reranked', 'pool')}""")
def rerank_lift(spark, sf):
    """The reranker on and off over the same candidates."""
    store = stored_catalog(spark, sf)
    docs = store.scan().withColumn("text", text_index.searchable_text())
    asked = kind_queries(spark, sf)
    after, before = hs.rerank_passes(asked, docs, 0.5, store.index())
    return _told(ev.paired_lift(asked, after, before, kind_judgments(spark, sf)))


@register("instruction_lift", f"""{STORED_SQL},
{_vectors('i', INSTRUCTION)},
instructed AS (SELECT qid, sku, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku) AS rank
  FROM veci QUALIFY rank <= 50),
bare AS (SELECT qid, sku, r AS rank FROM vectop),
{_lift_sql('instructed', 'bare')}""")
def instruction_lift(spark, sf):
    """Vector search for the queries with and without an instruction before them."""
    store = stored_catalog(spark, sf)
    asked = kind_queries(spark, sf)
    bare = retrievers.PivotRetriever()
    instructed = retrievers.PivotRetriever(embedder=hs.hashed_embedder(prefix=INSTRUCTION), _built=bare._built)
    return _told(ev.paired_lift(asked, instructed.search(asked, store, 50), bare.search(asked, store, 50),
                                kind_judgments(spark, sf)))


@register("pivot_knn", f"""WITH {KNN_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, CAST(d AS VARCHAR)) AS rank
  FROM (SELECT tenant, q, d, s FROM pairs UNION ALL
    SELECT 'v' || (vec_id % 2), vec_id, vec_id, round(list_sum(list_transform(embedding,
      lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 9) FROM embeddings))
SELECT tenant, CAST(q AS VARCHAR) AS qid, CAST(d AS VARCHAR) AS id, round(s, 6) AS score, rank
FROM r WHERE rank <= 5""")
def pivot_knn(spark, sf):
    v = st.vectors(spark, sf)
    index = pivot_index.build(v.select("tenant", "id", F.col("embedding").alias("v")), block_rows=128)
    asked = v.select("tenant", F.col("id").alias("qid"), F.col("embedding").alias("v"))
    return plain(pivot_index.nearest(asked, index, 5).hits)


def _tfidf(of: str, words: str) -> str:
    """Vectors of the rows ``of`` (id, tenant, words) by the frequencies of the documents."""
    return f"""WITH docs AS (SELECT doc_id, lang AS tenant, list_filter(string_split_regex(lower(
    coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS words FROM documents),
{of},
sizes AS (SELECT tenant, count(*) AS n FROM docs GROUP BY 1),
df AS (SELECT tenant, b, count(DISTINCT doc_id) AS df FROM (
    SELECT tenant, doc_id, ('0x' || substr(md5(unnest(words)), 1, 8))::UBIGINT % 256 AS b FROM docs) GROUP BY ALL),
tf AS (SELECT id, tenant, b, count(*) AS c FROM (
    SELECT id, tenant, ('0x' || substr(md5(unnest(words)), 1, 8))::UBIGINT % 256 AS b FROM {words}) GROUP BY ALL),
w AS (SELECT id, tenant, b, c * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS w
  FROM tf JOIN sizes USING (tenant) LEFT JOIN df USING (tenant, b))
SELECT id, tenant, CAST(b AS BIGINT) AS "at", round(w / sqrt(sum(w * w) OVER (PARTITION BY id, tenant)), 6) AS w FROM w"""


def _unfolded(rows: DataFrame) -> DataFrame:
    return plain(rows.select("id", "tenant", F.explode("sparse").alias("p")).select("id", "tenant", "p.at", "p.w"))


@register("embed_tfidf_documents", _tfidf("rows_ AS (SELECT doc_id AS id, tenant, words FROM docs)", "rows_"))
def embed_tfidf_documents(spark, sf):
    docs = st.wide(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tenant"), "text")
    counts = sparse_embed.counts_in_tasks()
    return _unfolded(sparse_embed.embed(docs, sparse_embed.learn(docs, counts=counts), counts=counts))


@register("embed_tfidf_queries", _tfidf(r"""rows_ AS (SELECT item_id AS id, t.tenant, list_filter(
    string_split_regex(lower('find: ' || text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS words
  FROM benchmark, (VALUES ('en'), ('fr'), ('de'), ('es')) t(tenant))""", "rows_"))
def embed_tfidf_queries(spark, sf):
    """Benchmark passages with an instruction, weighed by each tenant's documents."""
    docs = st.wide(spark, sf, "documents").select(F.col("lang").alias("tenant"), "text")
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), "text", F.explode(F.array(*map(F.lit, st.GOLDEN_TENANTS))).alias("tenant"))
    learned = sparse_embed.learn(docs, counts=sparse_embed.counts_in_tasks())
    return _unfolded(sparse_embed.embed(asked, learned, prefix=INSTRUCTION))
