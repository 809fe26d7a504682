"""Hybrid search for a whole table of queries in one plan.

Keyword and vector lists are each cut to the candidate pool, scaled to 0..1 per query,
blended, optionally reranked and sliced. Scores are rounded to nine places, so equal texts
tie whatever order their terms were added in; ties go by sku.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.routing import classify_query, decide_rerank, resolve_alpha
from shelfspark.functions.text import word_tokens
from shelfspark.functions.vectors import hashed_embedder
from shelfspark.operators import keyword_blocks
from shelfspark.operators.embeddings import knn_topk
from shelfspark.operators.filters import matches
from shelfspark.operators.ranks import spread_join, top_k
from shelfspark.operators.text_index import B, K1, StoredIndex, searchable_text, top_documents
from shelfspark.session import materialise
from shelfspark.sources.catalog import CatalogTable

POOL = 50
SORT_POOL = 50
SORT_KEYS = {"price_asc": ("price", False), "price_desc": ("price", True),
             "rating_desc": ("rating", True)}


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms per query."""
    return exploded(queries.select("qid", "tenant", F.array_distinct(
        word_tokens(F.col("query"))).alias("term")))


def exploded(rows: DataFrame, column: str = "term") -> DataFrame:
    """One row per element. The outer form plus a null test is used on purpose: a plain
    explode makes the optimizer test the size first, which computes the tokens again."""
    return rows.withColumn(column, F.explode_outer(column)).where(F.col(column).isNotNull())


def document_tokens(docs: DataFrame) -> Column:
    """Stored tokens when the catalog keeps them, else computed from the text."""
    return F.col("tokens") if "tokens" in docs.columns else word_tokens(F.col("text"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Document count and mean length per tenant."""
    return docs.select("tenant", F.size(document_tokens(docs)).alias("dl")).groupBy(
        "tenant").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Inverted index (tenant, term, sku, dl, tf), only for the given terms if any.

    docs: tenant, sku, text. The terms of one document start in one task, so the counts
    are complete before the shuffle.
    """
    tokens = docs.select("tenant", "sku", document_tokens(docs).alias("term"))
    seen = exploded(tokens.withColumn("dl", F.size("term")))
    if terms is not None:
        seen = seen.join(terms.select("tenant", "term").distinct(), ["tenant", "term"],
                         "left_semi")
    return seen.groupBy("tenant", "sku", "dl", "term").agg(F.count("*").alias("tf"))


def keyword_weights(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(tenant, qid, term, idf, avgdl) of every query term that a document of its tenant holds.

    One pass over the documents: the empty term, which no text holds, counts them and their lengths.
    """
    terms = query_terms(queries)
    asked = terms.select("tenant", "term")
    asked = materialise(asked.unionByName(asked.select("tenant", F.lit("").alias("term"))).distinct())
    counts = keyword_blocks.term_counts(docs, keyword_blocks.shared_terms(asked))
    held = materialise(counts.join(asked, ["tenant", "term"], "left_semi").groupBy(
        "tenant", "term").agg(F.sum("df").alias("df"), F.try_divide(F.sum("length"), F.sum("known")).alias("avgdl")))
    stats = held.where("term = ''").select("tenant", F.col("df").alias("n_docs"), "avgdl")
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return materialise(terms.join(held.drop("avgdl"), ["tenant", "term"]).join(stats, "tenant").select(
        "tenant", "qid", "term", idf.alias("idf"), "avgdl"))


def bm25(queries: DataFrame, docs: DataFrame, index: DataFrame | None = None, k: int | None = None,
         scoped: DataFrame | None = None) -> DataFrame:
    """BM25 (tenant, qid, sku, score) of every document sharing a term with its query.

    Document frequencies and lengths are those of the tenant. With ``k`` only rows that may be among
    a query's k best are sure to be there. ``scoped`` (scope, sku, tokens or text) are the documents that
    count for the queries of a scope, if these have one; otherwise all do. ``index`` holds saved
    postings; their hot terms are salted.
    """
    if index is None:
        weights = keyword_weights(queries, docs)
        if scoped is None:
            return keyword_blocks.scores(docs, weights, k)
        of_scope = weights.join(queries.select("qid", "scope"), "qid").drop("tenant").withColumnRenamed("scope", "tenant")
        found = keyword_blocks.scores(scoped.withColumnRenamed("scope", "tenant"), of_scope, k)
        return found.drop("tenant").join(queries.select("qid", "tenant"), "qid")
    terms = query_terms(queries)
    frequency = index.groupBy("tenant", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weights = (terms.join(frequency, ["tenant", "term"]).join(corpus_stats(docs), "tenant")
               .select("qid", "tenant", "term", "avgdl",
                       F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
                       .alias("idf")))
    met = spread_join(index, weights, ["tenant", "term"], F.col("sku"))
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("tenant", "qid", "sku").agg(F.round(F.sum(part), 9).alias("score"))


def vector_search(queries: DataFrame, vectors: DataFrame, depth: int = POOL) -> DataFrame:
    """Exact cosine list (tenant, qid, sku, score) per query within its tenant."""
    corpus = vectors.select("tenant", F.col("sku").alias("id"), F.col("embedding").alias("v"))
    asked = queries.select("tenant", "qid", F.col("embedding").alias("v"))
    return knn_topk(asked, corpus, depth).select("tenant", "qid", F.col("id").alias("sku"), "score")


def _scaled(hits: DataFrame, name: str) -> DataFrame:
    span = W.partitionBy("qid")
    low, high = F.min("score").over(span), F.max("score").over(span)
    return hits.select("tenant", "qid", "sku", F.when(high > low, (F.col("score") - low)
                       / (high - low)).otherwise(F.lit(1.0)).alias(name))


def pool_depths(planned: DataFrame, top: int = POOL) -> tuple[DataFrame, int]:
    """``pool`` per query, ``top`` or its own limit if that is larger; and the largest of all."""
    depths = planned.select("qid", F.greatest(F.lit(top), F.col("limit")).cast("int").alias("pool"))
    return depths, depths.agg(F.max("pool")).first()[0] or top


def _own_depth(ranked: DataFrame, depths: DataFrame | None) -> DataFrame:
    """Rows within their query's own depth, of lists cut at the largest."""
    if depths is None:
        return ranked
    return ranked.join(depths, "qid").where(F.col("rank") <= F.col("pool")).drop("pool")


def scaled_lists(keyword: DataFrame, vector: DataFrame, depth: int = POOL,
                 depths: DataFrame | None = None) -> DataFrame:
    """Both lists, cut and scaled, side by side; absent counts 0.

    ``depth`` is the largest pool of any query, by which the lists are cut before they are
    shuffled; ``depths`` (qid, pool) then cuts each query's lists at its own.
    """
    best = [F.desc("score"), F.asc("sku")]
    kw = _scaled(_own_depth(top_k(keyword, ["qid"], best, depth), depths).drop("rank"), "kw")
    vec = _scaled(_own_depth(top_k(vector, ["qid"], best, depth), depths).drop("rank"), "vec")
    return kw.join(vec, ["tenant", "qid", "sku"], "full_outer").na.fill(0.0, ["kw", "vec"])


def fuse(lists: DataFrame, alpha: Column) -> DataFrame:
    """Blended score: 0 is keyword only, 1 is vector only."""
    blend = F.round(alpha * F.col("vec") + (1 - alpha) * F.col("kw"), 9)
    return lists.withColumn("score", blend)


def lexical_pair_score(query: Column, text: Column) -> Column:
    """Default reranker: share of the query's terms in the text, plus half for the phrase."""
    asked = F.array_distinct(word_tokens(query))
    shared = F.size(F.array_intersect(asked, word_tokens(text)))
    phrase = F.when(F.contains(F.lower(text), F.lower(F.trim(query))), 0.5).otherwise(0.0)
    return F.coalesce(F.try_divide(shared, F.size(asked)), F.lit(0.0)) + phrase


def rerank(pool: DataFrame, texts: DataFrame,
           scorer: Callable[[Column, Column], Column] = lexical_pair_score) -> DataFrame:
    """Pool rows with rerank_score; ordering is by it, then by the rank before.

    pool: tenant, qid, query, sku, rank_before_rerank. texts: tenant, sku, text.
    """
    return pool.join(texts.select("tenant", "sku", F.col("text").alias("_text")),
                     ["tenant", "sku"]).withColumn(
        "rerank_score", F.round(scorer(F.col("query"), F.col("_text")), 9)).drop("_text")


def scopes(queries: DataFrame) -> DataFrame:
    """Queries with scope: one id per tenant and distinct filter."""
    return queries.withColumn("scope", F.concat_ws("/", "tenant", F.to_json("filters")))


def scoped_products(asked: DataFrame, products: DataFrame) -> DataFrame:
    """Products that pass each distinct filter of their tenant, once per filter."""
    distinct = asked.select("tenant", "scope", "filters").dropDuplicates(["tenant", "scope"])
    return spread_join(products, distinct, ["tenant"], F.col("sku")).where(
        matches(F.col("filters"))).drop("filters")


def plan_queries(queries: DataFrame, merchants: DataFrame | None = None,
                 tuned: dict[str, float] | None = None, dynamic: bool = True,
                 rerank_default: bool = False) -> DataFrame:
    """Queries with class, alpha_used and do_rerank; explicit columns beat merchant settings."""
    have = set(queries.columns)
    routed = classify_query(queries)
    if merchants is not None:
        routed = routed.join(merchants.select(
            "tenant", F.col("alpha_override").alias("_alpha"),
            F.col("rerank_enabled").alias("_rerank")), "tenant", "left")
    merchant = (F.col("_alpha"), F.col("_rerank")) if merchants is not None else (None, None)
    planned = routed.withColumns({
        "alpha_used": resolve_alpha(F.col("query_class"),
                                    F.col("alpha") if "alpha" in have else None,
                                    merchant[0], tuned, dynamic),
        "do_rerank": decide_rerank(F.col("query"), F.col("rerank") if "rerank" in have else None,
                                   merchant[1], rerank_default),
    })
    if "limit" not in have:
        planned = planned.withColumn("limit", F.lit(10))
    return planned.drop("_alpha", "_rerank")


def candidate_lists(queries: DataFrame, docs: DataFrame, embedder=None, depth: int = POOL,
                    index: DataFrame | None = None, depths: DataFrame | None = None,
                    stored: StoredIndex | None = None) -> DataFrame:
    """Scaled keyword and vector lists of all queries, cut as ``scaled_lists`` says.

    docs: tenant, sku, text and optionally tokens, embedding and the filter fields; what the
    catalog already stores (also ``index``, its saved postings) is not computed again. With a
    ``filters`` column the filters apply before either list is cut, while term statistics
    stay those of the whole tenant. With a ``stored`` index only the documents that may be
    among a query's ``depth`` best are scored, and nothing is tokenised. The lists, two pools a
    query, are stored, so what follows may read them many times.
    """
    embed = embedder or hashed_embedder()
    if "embedding" not in docs.columns:
        docs = docs.withColumn("embedding", embed("text"))
    if "embedding" not in queries.columns:
        queries = queries.withColumn("embedding", embed("query"))
    best = lambda asked, allowed=None: top_documents(asked, stored, depth, allowed).drop("rank")
    if "filters" not in queries.columns:
        keyword = best(queries) if stored else bm25(queries, docs, index, depth)
        return materialise(scaled_lists(keyword, vector_search(queries, docs, depth), depth, depths))
    asked = scopes(queries)
    allowed = scoped_products(asked, docs.drop("text"))
    if stored:
        keyword = best(asked, allowed)
    elif index is None:
        told = "tokens" if "tokens" in docs.columns else "text"
        products = scoped_products(asked, docs.drop("embedding"))
        keyword = bm25(asked, docs, k=depth, scoped=products.select("scope", "sku", told))
    else:
        keyword = bm25(queries, docs, index).join(asked.select("qid", "scope"), "qid").join(
            allowed.select("scope", "sku"), ["scope", "sku"], "left_semi").drop("scope")
    vector = vector_search(asked.select("qid", F.col("scope").alias("tenant"), "embedding"),
                           allowed.select(F.col("scope").alias("tenant"), "sku", "embedding"),
                           depth)
    vector = vector.drop("tenant").join(asked.select("qid", "tenant"), "qid")
    return materialise(scaled_lists(keyword, vector, depth, depths))


def search(queries: DataFrame, docs: DataFrame, merchants: DataFrame | None = None,
           embedder=None, scorer=lexical_pair_score, top: int = POOL,
           index: DataFrame | None = None, stored: StoredIndex | None = None, **options) -> DataFrame:
    """Hits of every query: qid, tenant, sku, rank, score, rank_before_rerank, rerank_score,
    query_class, alpha_used, reranked, retrieved_count (candidates before the limit).

    queries: qid, tenant, query and optionally limit, alpha, rerank, filters. A query's pool
    holds ``top`` candidates, or its own limit when it asks for more.
    """
    planned = plan_queries(queries, merchants, **options)
    depths, depth = pool_depths(planned, top)
    lists = candidate_lists(queries, docs, embedder, depth, index, depths, stored)
    settings = planned.select("qid", "query", "query_class", "alpha_used", "do_rerank", "limit")
    fused = fuse(lists.join(settings, "qid"), F.col("alpha_used"))
    best = top_k(fused, ["qid"], [F.desc("score"), F.asc("sku")], depth)
    pool = materialise(_own_depth(best, depths).withColumn(
        "rank_before_rerank", F.col("rank") - 1).withColumn(
        "retrieved_count", F.count("*").over(W.partitionBy("qid"))).drop("rank", "kw", "vec"))
    plain = pool.where(~F.col("do_rerank")).withColumns({
        "rank": F.col("rank_before_rerank") + 1, "rerank_score": F.lit(None).cast("double")})
    scored = rerank(pool.where("do_rerank"), docs.select("tenant", "sku", "text"), scorer)
    ordered = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(
        F.desc("rerank_score"), F.asc("rank_before_rerank")))).withColumn(
        "score", F.col("rerank_score"))
    hits = plain.unionByName(ordered).where(F.col("rank") <= F.col("limit"))
    return hits.select("qid", "tenant", "sku", "rank", "score", "rank_before_rerank",
                       "rerank_score", "query_class", "alpha_used",
                       F.col("do_rerank").alias("reranked"), "retrieved_count")


def search_catalog(queries: DataFrame, store: CatalogTable, **options) -> DataFrame:
    """``search`` over a stored catalog that keeps an index and embeddings."""
    docs = store.scan().withColumn("text", searchable_text())
    return search(queries, docs, stored=store.index(), **options)


def rerank_passes(queries: DataFrame, docs: DataFrame, alpha: float, stored: StoredIndex | None = None,
                  scorer=lexical_pair_score, top: int = POOL) -> tuple[DataFrame, DataFrame]:
    """The same candidate pools (qid, sku, rank) reranked and not."""
    lists = candidate_lists(queries, docs, depth=top, stored=stored)
    best = top_k(fuse(lists, F.lit(alpha)), ["qid"], [F.desc("score"), F.asc("sku")], top)
    pool = materialise(best.join(queries.select("qid", "query"), "qid").select(
        "tenant", "qid", "query", "sku", (F.col("rank") - 1).alias("rank_before_rerank")))
    scored = rerank(pool, docs.select("tenant", "sku", "text"), scorer)
    order = W.partitionBy("qid").orderBy(F.desc("rerank_score"), F.asc("rank_before_rerank"))
    return (scored.select("qid", "sku", F.row_number().over(order).alias("rank")),
            pool.select("qid", "sku", (F.col("rank_before_rerank") + 1).alias("rank")))


def responses(queries: DataFrame, hits: DataFrame, **options) -> DataFrame:
    """One row per query, also for queries without hits."""
    planned = plan_queries(queries, **options)
    found = hits.groupBy("qid").agg(F.count("*").alias("n_hits"),
                                    F.max("retrieved_count").alias("retrieved_count"))
    return planned.join(found, "qid", "left").select(
        "qid", "tenant", "query_class", "confidence", "alpha_used",
        F.col("do_rerank").alias("reranked"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.coalesce("retrieved_count", F.lit(0)).alias("retrieved_count"))


def search_sorted(hits: DataFrame, products: DataFrame, sort_by: str, limit: int = 5) -> DataFrame:
    """The relevance pool of each query ordered by a product field, rank breaking ties."""
    field, descending = SORT_KEYS[sort_by]
    keyed = hits.select("qid", "tenant", "sku", F.col("rank").alias("pool_rank")).join(
        products.select("tenant", "sku", F.col(field).alias("sort_value")),
        ["tenant", "sku"]).where(F.col("sort_value").isNotNull())
    order = F.desc("sort_value") if descending else F.asc("sort_value")
    return top_k(keyed, ["qid"], [order, F.asc("pool_rank")], limit)
