"""Query routing and hybrid retrieval over whole query tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import routing
from shelfspark.functions.text import word_tokens
from shelfspark.functions.vectors import hashed_embedder
from shelfspark.operators import filters
from shelfspark.operators import search as hs
from shelfspark.plans import standins as st
from shelfspark.plans.feed_queries import merchant_settings
from shelfspark.plans.registry import register, table
from shelfspark.plans.shapes import plain

TERMS_SQL = f"""WITH {st.DOCS_SQL}, {st.GOLDEN_SQL},
occ AS (SELECT tenant, sku, len(toks) AS dl, unnest(toks) AS term FROM docs),
tf AS (SELECT tenant, sku, dl, term, count(*) AS tf FROM occ GROUP BY ALL),
stats AS (SELECT tenant, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM docs GROUP BY 1),
qterms AS (SELECT DISTINCT qid, tenant, unnest(list_filter(string_split_regex(lower(query),
  '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM golden),
df AS (SELECT tenant, term, count(*) AS df FROM tf GROUP BY 1, 2),
kw AS (
  SELECT tf.tenant, qid, sku, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qterms JOIN tf USING (tenant, term) JOIN df USING (tenant, term) JOIN stats USING (tenant)
  GROUP BY ALL)"""

VECTORS_SQL = f"""{TERMS_SQL},
dbuckets AS (SELECT tenant, sku, ('0x' || substr(md5(term), 1, 8))::UBIGINT % 64 AS b,
    CAST(sum(tf) AS DOUBLE) AS c FROM tf GROUP BY ALL),
dvec AS (SELECT tenant, sku, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY tenant, sku))
  AS FLOAT) AS DOUBLE) AS x FROM dbuckets),
qocc AS (SELECT qid, tenant, unnest(list_filter(string_split_regex(lower(query),
  '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM golden),
qbuckets AS (SELECT qid, tenant, ('0x' || substr(md5(term), 1, 8))::UBIGINT % 64 AS b,
    CAST(count(*) AS DOUBLE) AS c FROM qocc GROUP BY ALL),
qvec AS (SELECT qid, tenant, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY qid))
  AS FLOAT) AS DOUBLE) AS x FROM qbuckets),
near AS (SELECT qid, d.tenant, sku, sum(q.x * d.x) AS s FROM qvec q JOIN dvec d
  ON d.tenant = q.tenant AND d.b = q.b GROUP BY ALL),
vec AS (SELECT g.qid, d.tenant, d.sku, round(coalesce(s, 0.0), 9) AS score
  FROM golden g JOIN docs d ON d.tenant = g.tenant
  LEFT JOIN near n ON n.qid = g.qid AND n.sku = d.sku)"""

LISTS_SQL = f"""{VECTORS_SQL},
kwtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku)
  AS r FROM kw) WHERE r <= 50),
vectop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku)
  AS r FROM vec) WHERE r <= 50),
kws AS (SELECT qid, tenant, sku, CASE WHEN max(score) OVER w > min(score) OVER w
    THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS kw
  FROM kwtop WINDOW w AS (PARTITION BY qid)),
vecs AS (SELECT qid, tenant, sku, CASE WHEN max(score) OVER w > min(score) OVER w
    THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS vec
  FROM vectop WINDOW w AS (PARTITION BY qid)),
lists AS (SELECT qid, tenant, sku, coalesce(kw, 0.0) AS kw, coalesce(vec, 0.0) AS vec
  FROM kws FULL JOIN vecs USING (qid, tenant, sku))"""


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return st.golden_queries(spark, sf).select("qid", "tenant", "query")


@register("tokenize_word", f"""WITH {st.DOCS_SQL}
SELECT sku, len(toks) AS n, md5(array_to_string(toks, ' ')) AS digest FROM docs""")
def tokenize_word(spark, sf):
    tokens = word_tokens(F.col("text"))
    return plain(st.docs(spark, sf).select("sku", F.size(tokens).alias("n"), F.md5(
        F.array_join(tokens, " ")).alias("digest")))


@register("bm25", f"""{TERMS_SQL}
SELECT qid, tenant, sku, round(score, 6) AS score FROM kw""")
def bm25(spark, sf):
    return plain(hs.bm25(queries(spark, sf), st.docs(spark, sf)))


@register("bm25_preview", f"""{TERMS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku) AS rank FROM kw)
SELECT qid, sku, rank FROM r WHERE rank <= 10""")
def bm25_preview(spark, sf):
    hits = hs.top_k(hs.bm25(queries(spark, sf), st.docs(spark, sf), k=10), ["qid"],
                    [F.desc("score"), F.asc("sku")], 10)
    return plain(hits.select("qid", "sku", "rank"))


@register("embed_documents", r"""WITH docs AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'),
    lambda t: t <> '')) AS term FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::UBIGINT % 64 AS b, CAST(count(*) AS DOUBLE)
  AS c FROM docs GROUP BY ALL)
SELECT doc_id, CAST(b AS BIGINT) AS at, round(CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5)
  AS x FROM b""")
def embed_documents(spark, sf):
    vectors = st.wide(spark, sf, "documents").select("doc_id", F.posexplode(
        hashed_embedder()("text")).alias("at", "x"))
    return plain(vectors.where("x > 0").withColumn("x", F.round(F.col("x").cast("double"), 5)))


@register("embed_queries", r"""WITH words AS (
  SELECT item_id, unnest(list_filter(string_split_regex(lower('find: ' || text),
    '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark),
b AS (SELECT item_id, ('0x' || substr(md5(term), 1, 8))::UBIGINT % 64 AS b, CAST(count(*) AS DOUBLE)
  AS c FROM words GROUP BY ALL)
SELECT item_id, CAST(b AS BIGINT) AS at, round(CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY item_id)) AS FLOAT) AS DOUBLE), 5)
  AS x FROM b""")
def embed_queries(spark, sf):
    vectors = table(spark, sf, "benchmark").select("item_id", F.posexplode(
        hashed_embedder(prefix="find: ")("text")).alias("at", "x"))
    return plain(vectors.where("x > 0").withColumn("x", F.round(F.col("x").cast("double"), 5)))


@register("vector_search", f"""{VECTORS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku) AS rank FROM vec)
SELECT qid, tenant, sku, round(score, 6) AS score FROM r WHERE rank <= 10""")
def vector_search(spark, sf):
    embed = hashed_embedder()
    asked = queries(spark, sf).withColumn("embedding", embed("query"))
    corpus = st.docs(spark, sf).withColumn("embedding", embed("text"))
    found = hs.vector_search(asked, corpus, 10)
    return found.select("qid", "tenant", "sku", F.round("score", 6).alias("score"))


def _lists(spark, sf):
    return hs.candidate_lists(queries(spark, sf), st.docs(spark, sf))


@register("hybrid_fusion", f"""{LISTS_SQL}
SELECT qid, tenant, sku, round(kw, 5) AS kw, round(vec, 5) AS vec,
  round(0.5 * vec + 0.5 * kw, 5) AS score FROM lists""")
def hybrid_fusion(spark, sf):
    fused = hs.fuse(_lists(spark, sf), F.lit(0.5))
    return fused.select("qid", "tenant", "sku", *[F.round(c, 5).alias(c)
                                                  for c in ("kw", "vec", "score")])


@register("hybrid_preview", f"""{LISTS_SQL},
f AS (SELECT *, round(0.5 * vec + 0.5 * kw, 9) AS score FROM lists),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku) AS rank FROM f)
SELECT qid, sku, rank FROM r WHERE rank <= 10""")
def hybrid_preview(spark, sf):
    fused = hs.fuse(_lists(spark, sf), F.lit(0.5))
    return plain(hs.top_k(fused, ["qid"], [F.desc("score"), F.asc("sku")], 10).select(
        "qid", "sku", "rank"))


def _class_sql(source: str, query: str) -> str:
    """Query classification in the checking engine's dialect (ASCII patterns)."""
    ident = (r"(regexp_matches(t, '^[a-z0-9]+([-_/][a-z0-9]+)*$') AND regexp_matches(t, '\d') "
             r"AND regexp_matches(t, '[a-z]')) OR regexp_matches(t, "
             r"'^[a-z]{1,4}[-_]?\d{2,}[a-z0-9-]*$') OR regexp_matches(t, '^\d{6,}$')")

    def rx(pattern: str) -> str:
        return pattern.replace("'", "''")

    return rf"""tok AS (SELECT *, trim({query}) AS q, regexp_extract_all(trim({query}),
    '[\p{{L}}\p{{N}}_\-/]+') AS toks FROM {source}),
  sig AS (SELECT *, len(toks) AS n,
    len(list_filter(list_transform(toks, lambda t: lower(t)), lambda t: {ident})) AS ids,
    len(list_filter(toks, lambda t: length(t) > 2 AND t = upper(t) AND t <> lower(t))) > 0 AS caps,
    regexp_matches(q, '{rx(routing.QUOTED)}') AS quoted,
    regexp_matches(q, '(?i){rx(routing.MEASUREMENT)}') AS measured,
    len(regexp_extract_all(q, '(?i){rx(routing.ATTRIBUTE_CUE)}')) AS attrs,
    regexp_matches(q, '(?i){rx(routing.EXPLORATORY_CUE)}') AS intent,
    regexp_matches(q, '(?i){rx(routing.NEED_FRAME_CUE)}') AS need,
    regexp_matches(q, '(?i){rx(routing.CONTEXT_CUE)}') AS context,
    regexp_matches(q, '(?i){rx(routing.QUESTION_CUE)}') AS question,
    NOT regexp_matches(q, '\d') AS digitless FROM tok),
  pts AS (SELECT *,
    CAST(CASE WHEN ids > 0 THEN 2.5 * (ids / greatest(n, 1)) + 1.0 ELSE 0 END
      + CASE WHEN quoted THEN 1.0 ELSE 0 END + CASE WHEN caps THEN 0.5 ELSE 0 END AS DOUBLE) AS i,
    CAST(CASE WHEN measured THEN 1.8 ELSE 0 END + 0.7 * least(attrs, 3)
      + CASE WHEN n > 3 AND n <= 8 THEN 0.5 ELSE 0 END AS DOUBLE) AS a,
    CAST(CASE WHEN intent THEN 2.0 ELSE 0 END + CASE WHEN need THEN 2.0 ELSE 0 END
      + CASE WHEN context THEN 2.0 ELSE 0 END + CASE WHEN question THEN 0.8 ELSE 0 END
      + CASE WHEN n > 8 THEN 0.8 ELSE 0 END
      + CASE WHEN digitless AND n >= 4 THEN 0.4 ELSE 0 END AS DOUBLE) AS e FROM sig),
  classified AS (SELECT *, CASE WHEN q = '' THEN 'exploratory' WHEN greatest(e, a, i) = 0
      THEN 'attribute' WHEN e = greatest(e, a, i) THEN 'exploratory'
      WHEN a = greatest(e, a, i) THEN 'attribute' ELSE 'identifier' END AS query_class,
    CASE WHEN q = '' OR greatest(e, a, i) = 0 THEN 0.0
      ELSE greatest(e, a, i) / (e + a + i) END AS confidence FROM pts)"""


SHOPPER_WORDS = ("something for a", "gift", "waterproof", "red", "size 10", "55X900H", "under 500",
                 "which", "?", "way to", "'blue jeans'", "DW-4402B", "everyday", "4k", "SONY", "")


def _shopper(spark, sf, name="orders"):
    """Queries put together from cue words and row values, one per row of a table."""
    words = F.array(*[F.lit(w) for w in SHOPPER_WORDS])
    k = F.col("o_orderkey")
    pick = lambda n: F.get(words, ((k * n + F.floor(k / 16)) % len(SHOPPER_WORDS)).cast("int"))
    text = F.concat_ws(" ", pick(1), F.when(k % 3 == 0, F.lower(F.split_part(
        "o_orderpriority", F.lit("-"), F.lit(2)))), pick(5), F.when(k % 7 == 0, pick(3)))
    return st.wide(spark, sf, name).select("o_orderkey", text.alias("query"))


SHOPPER_SQL = (
    "words AS (SELECT [" + ", ".join("'" + w.replace("'", "''") + "'" for w in SHOPPER_WORDS)
    + "] AS w), shopper AS (SELECT o_orderkey, concat_ws(' ', w[1 + (o_orderkey + o_orderkey // 16)"
    " % 16], CASE WHEN o_orderkey % 3 = 0 THEN lower(split_part(o_orderpriority, '-', 2)) END, "
    "w[1 + (o_orderkey * 5 + o_orderkey // 16) % 16], CASE WHEN o_orderkey % 7 = 0 THEN "
    "w[1 + (o_orderkey * 3 + o_orderkey // 16) % 16] END) AS query FROM orders, words)")


@register("classify_query", f"""WITH {SHOPPER_SQL}, {_class_sql('shopper', 'query')}
SELECT o_orderkey, query_class, CAST(round_even(confidence, 3) AS DOUBLE) AS confidence, ids > 0 AS has_identifier
FROM classified""")
def classify_query(spark, sf):
    out = routing.classify_query(_shopper(spark, sf))
    return out.select("o_orderkey", "query_class", "confidence",
                      "has_identifier")


@register("has_identifier_token", rf"""WITH toks AS (
  SELECT page_id, list_transform(regexp_extract_all(url, '[\w\-/]+'), lambda t: lower(t)) AS t
  FROM pages)
SELECT page_id, len(list_filter(t, lambda x:
  (regexp_matches(x, '^[a-z0-9]+([-_/][a-z0-9]+)*$') AND regexp_matches(x, '\d')
    AND regexp_matches(x, '[a-z]')) OR regexp_matches(x, '^[a-z]{{1,4}}[-_]?\d{{2,}}[a-z0-9-]*$')
  OR regexp_matches(x, '^\d{{6,}}$'))) > 0 AS has_identifier FROM toks""")
def has_identifier_token(spark, sf):
    return table(spark, sf, "pages").select("page_id", routing.has_identifier_token(
        F.col("url")).alias("has_identifier"))


@register("classify_complexity", rf"""
SELECT conv_id, turn, CASE WHEN turn >= 6 OR regexp_matches(text, '(?i){routing.COMPARISON_CUE}')
    OR len(regexp_extract_all(text, '(?i){routing.CONSTRAINT_JOIN}')) >= 2
    OR len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_$%]+')) >= 25 THEN 'reasoning' ELSE 'fast' END
  AS tier,
  len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_$%]+')) >= 25 AND turn < 6 AS is_long
FROM conversations""")
def classify_complexity(spark, sf):
    rounds = F.floor(F.col("turn") / 3).cast("int")
    routed = table(spark, sf, "conversations").withColumn(
        "r", routing.classify_complexity(F.col("text"), rounds))
    return routed.select("conv_id", "turn", F.col("r.tier").alias("tier"), F.exists(
        "r.reasons", lambda x: F.endswith(x, F.lit(routing.LENGTH_REASON))).alias("is_long"))


@register("alpha_resolve", f"""WITH {SHOPPER_SQL}, {_class_sql('shopper', 'query')}
SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 10 = 0 THEN 0.9 END,
    CASE WHEN o_orderkey % 3 = 0 THEN 0.3 END,
    CASE query_class WHEN 'exploratory' THEN 0.75 WHEN 'attribute' THEN 0.6 ELSE 0.15 END)
  AS DOUBLE) AS alpha, CAST(0.5 AS DOUBLE) AS static_alpha FROM classified""")
def alpha_resolve(spark, sf):
    k = F.col("o_orderkey")
    asked = routing.classify_query(_shopper(spark, sf))
    alpha = routing.resolve_alpha(F.col("query_class"), F.when(k % 10 == 0, 0.9),
                                  F.when(k % 3 == 0, 0.3), tuned={"attribute": 0.6})
    fixed = routing.resolve_alpha(F.col("query_class"), dynamic=False)
    return plain(asked.select("o_orderkey", alpha.alias("alpha"), fixed.alias("static_alpha")))


@register("rerank_decide", f"""WITH {SHOPPER_SQL}, {_class_sql('shopper', 'query')}
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN true WHEN o_orderkey % 10 = 1 THEN false
  ELSE coalesce(CASE WHEN o_orderkey % 3 = 1 THEN true WHEN o_orderkey % 3 = 2 THEN false END, true)
    AND ids = 0 END AS rerank FROM classified""")
def rerank_decide(spark, sf):
    k = F.col("o_orderkey")
    explicit = F.when(k % 10 == 0, True).when(k % 10 == 1, False)
    merchant = F.when(k % 3 == 1, True).when(k % 3 == 2, False)
    return _shopper(spark, sf).select("o_orderkey", routing.decide_rerank(
        F.col("query"), explicit, merchant, True).alias("rerank"))


@register("join_settings", f"""WITH {SHOPPER_SQL}, {_class_sql('shopper', 'query')}
SELECT o_orderkey AS qid, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0.3 ELSE CASE query_class
    WHEN 'exploratory' THEN 0.75 WHEN 'attribute' THEN 0.5 ELSE 0.15 END END AS DOUBLE)
  AS alpha_used, o_orderkey % 3 = 1 AND ids = 0 AS do_rerank FROM classified""")
def join_settings(spark, sf):
    asked = _shopper(spark, sf).select(F.col("o_orderkey").alias("qid"), "query", F.concat(
        F.lit("t"), (F.col("o_orderkey") % 3).cast("string")).alias("tenant"))
    planned = hs.plan_queries(asked, merchant_settings(spark))
    return plain(planned.select("qid", "alpha_used", "do_rerank"))


RANKED_SQL = f"""{LISTS_SQL}, {_class_sql('golden', 'query')},
fused AS (SELECT l.*, query, query_class, confidence, CASE query_class WHEN 'exploratory' THEN 0.75
    WHEN 'attribute' THEN 0.5 ELSE 0.15 END AS alpha,
    len(list_filter(toks, lambda t: false)) = 1 AS never, ids = 0 AND l.tenant = 'en' AS do_rerank
  FROM lists l JOIN classified c ON c.qid = l.qid),
pool AS (SELECT * FROM (SELECT *, round(alpha * vec + (1 - alpha) * kw, 9) AS score,
    row_number() OVER (PARTITION BY qid ORDER BY round(alpha * vec + (1 - alpha) * kw, 9) DESC, sku)
      - 1 AS rank_before FROM fused) WHERE rank_before < 50)"""

RERANKED_SQL = f"""{RANKED_SQL},
qset AS (SELECT qid, list(DISTINCT term) AS asked FROM qterms GROUP BY 1),
scored AS (SELECT p.*, CASE WHEN do_rerank THEN round(len(list_intersect(asked, toks))
      / CAST(len(asked) AS DOUBLE)
      + CASE WHEN contains(lower(text), lower(trim(query))) THEN 0.5 ELSE 0.0 END, 9) END
    AS rerank_score
  FROM pool p JOIN docs d ON d.tenant = p.tenant AND d.sku = p.sku JOIN qset USING (qid)),
final AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC NULLS LAST,
    rank_before) AS rank FROM scored)"""


def _search(spark, sf, **options):
    asked = queries(spark, sf).withColumn("rerank", F.when(F.col("tenant") != "en", False))
    return hs.search(asked, st.docs(spark, sf), rerank_default=True, **options)


@register("search", f"""{RERANKED_SQL}
SELECT qid, tenant, sku, rank, rank_before AS rank_before_rerank,
  round(coalesce(rerank_score, score), 5) AS score, query_class, CAST(alpha AS DOUBLE)
  AS alpha_used, do_rerank AS reranked FROM final WHERE rank <= 10""")
def search(spark, sf):
    hits = _search(spark, sf)
    return hits.select("qid", "tenant", "sku", F.col("rank").cast("long"),
                       F.col("rank_before_rerank").cast("long"),
                       F.round("score", 5).alias("score"), "query_class", "alpha_used", "reranked")


@register("search_responses", f"""{RERANKED_SQL}
SELECT c.qid, c.query_class, CAST(round_even(c.confidence, 3) AS DOUBLE) AS confidence,
  (SELECT count(*) FROM final f WHERE f.qid = c.qid AND rank <= 10) AS n_hits,
  (SELECT count(*) FROM final f WHERE f.qid = c.qid) AS retrieved_count FROM classified c""")
def search_responses(spark, sf):
    answered = hs.responses(queries(spark, sf), _search(spark, sf))
    return answered.select("qid", "query_class", "confidence",
                           "n_hits", "retrieved_count")


@register("rank_pre_rerank", f"""{RANKED_SQL}
SELECT qid, sku, rank_before AS rank_before_rerank FROM pool""")
def rank_pre_rerank(spark, sf):
    asked = queries(spark, sf).withColumns({"rerank": F.lit(False), "limit": F.lit(50)})
    return plain(hs.search(asked, st.docs(spark, sf)).select("qid", "sku", "rank_before_rerank"))


@register("rerank", f"""{RERANKED_SQL}
SELECT qid, sku, round(rerank_score, 6) AS rerank_score FROM final WHERE do_rerank""")
def rerank(spark, sf):
    asked = queries(spark, sf).withColumns({
        "limit": F.lit(50), "rerank": F.when(F.col("tenant") != "en", False)})
    hits = hs.search(asked, st.docs(spark, sf), rerank_default=True)
    return plain(hits.where("reranked").select("qid", "sku", "rerank_score"))


# Limits from 1 to 100, each query with a pool of its own.
OWN_LIMIT = "(1 + CAST(split_part(qid, '-', 2) AS INT) * 37 % 100)"
DEEP_SQL = RANKED_SQL.replace("WHERE r <= 50", f"WHERE r <= greatest(50, {OWN_LIMIT})").replace(
    "WHERE rank_before < 50", f"WHERE rank_before < greatest(50, {OWN_LIMIT})")


@register("topk_per_query", f"""{DEEP_SQL}
SELECT qid, sku, rank_before + 1 AS rank FROM pool WHERE rank_before < {OWN_LIMIT}""")
def topk_per_query(spark, sf):
    asked = queries(spark, sf).withColumns({"rerank": F.lit(False), "limit": F.expr(OWN_LIMIT)})
    return plain(hs.search(asked, st.docs(spark, sf)).select("qid", "sku", "rank"))


@register("search_filtered", f"""{VECTORS_SQL},
meta AS (SELECT lang AS tenant, 'D' || doc_id AS sku, CAST(n_chars AS DOUBLE) AS price, source
  FROM documents),
asks AS (SELECT qid, tenant, CASE WHEN length(qid) % 2 = 0 THEN 500.0 END AS lo,
  CASE WHEN length(qid) % 3 = 0 THEN ['src1', 'src4', 'src7'] END AS brands FROM golden),
ok AS (SELECT qid, m.tenant, sku FROM asks a JOIN meta m ON m.tenant = a.tenant
  AND (lo IS NULL OR price >= lo) AND (brands IS NULL OR list_contains(brands, source))),
kwtop AS (SELECT * FROM (SELECT kw.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sku)
  AS r FROM kw JOIN ok USING (qid, tenant, sku)) WHERE r <= 50),
vectop AS (SELECT * FROM (SELECT vec.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC,
  sku) AS r FROM vec JOIN ok USING (qid, tenant, sku)) WHERE r <= 50),
kws AS (SELECT qid, tenant, sku, CASE WHEN max(score) OVER w > min(score) OVER w
    THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS kw
  FROM kwtop WINDOW w AS (PARTITION BY qid)),
vecs AS (SELECT qid, tenant, sku, CASE WHEN max(score) OVER w > min(score) OVER w
    THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS vec
  FROM vectop WINDOW w AS (PARTITION BY qid)),
lists AS (SELECT qid, tenant, sku, coalesce(kw, 0.0) AS kw, coalesce(vec, 0.0) AS vec
  FROM kws FULL JOIN vecs USING (qid, tenant, sku)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(0.4 * vec + 0.6 * kw, 9) DESC,
  sku) AS rank FROM lists)
SELECT qid, tenant, sku, rank FROM r WHERE rank <= 10""")
def search_filtered(spark, sf):
    """Per-query filters: text length as price, source as brand."""
    extra = st.wide(spark, sf, "documents").select(
        F.col("lang").alias("tenant"), F.concat(F.lit("D"), F.col("doc_id").cast("string"))
        .alias("sku"), "text", F.col("n_chars").cast("decimal(18,4)").alias("price"),
        F.col("source").alias("brand"), F.array().cast("array<string>").alias("category_path"),
        F.lit(True).alias("in_stock"), F.lit(None).cast("string").alias("gender"),
        F.lit(None).cast("double").alias("rating"))
    n = F.length("qid")
    wanted = F.struct(
        F.when(n % 2 == 0, F.lit(500).cast("decimal(18,4)")).alias("min_price"),
        F.lit(None).cast("decimal(18,4)").alias("max_price"),
        F.when(n % 3 == 0, F.array(F.lit("src1"), F.lit("src4"), F.lit("src7"))).alias("brands"),
        F.lit(None).cast("array<string>").alias("categories"), F.lit(False).alias("in_stock_only"),
        F.lit(None).cast("array<string>").alias("genders"),
        F.lit(None).cast("double").alias("min_rating"))
    asked = queries(spark, sf).withColumns({
        "filters": wanted, "alpha": F.lit(0.4), "rerank": F.lit(False)})
    return plain(hs.search(asked, extra).select("qid", "tenant", "sku", "rank"))


@register("sort_pool", f"""{RANKED_SQL},
s AS (SELECT qid, p.sku, n_chars, row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC,
    rank_before) AS rank
  FROM pool p JOIN documents d ON p.sku = 'D' || d.doc_id WHERE doc_id % 5 <> 0)
SELECT qid, sku, CAST(n_chars AS DOUBLE) AS sort_value, rank FROM s WHERE rank <= 5""")
def sort_pool(spark, sf):
    asked = queries(spark, sf).withColumns({"rerank": F.lit(False),
                                            "limit": F.lit(hs.SORT_POOL)})
    hits = hs.search(asked, st.docs(spark, sf))
    priced = table(spark, sf, "documents").select(
        F.col("lang").alias("tenant"), F.concat(F.lit("D"), F.col("doc_id").cast("string"))
        .alias("sku"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars").cast("double"))
        .alias("price"))
    return plain(hs.search_sorted(hits, priced, "price_desc").select(
        "qid", "sku", "sort_value", "rank"))


@register("search_exhaustive_sort", f"""WITH {st.PRODUCTS_SQL},
r AS (SELECT tenant, sku, rating, row_number() OVER (PARTITION BY tenant ORDER BY rating DESC, sku)
  AS rank FROM products WHERE rating IS NOT NULL AND in_stock)
SELECT tenant, sku, round(rating, 6) AS rating, rank FROM r WHERE rank <= 5""")
def search_exhaustive_sort(spark, sf):
    """Ordering a whole filtered catalog instead of a pool."""
    kept = filters.where_filters(st.products(spark, sf, reviews=True), in_stock_only=True)
    best = hs.top_k(kept.where(F.col("rating").isNotNull()), ["tenant"],
                    [F.desc("rating"), F.asc("sku")], 5)
    return plain(best.select("tenant", "sku", "rating", "rank"))
