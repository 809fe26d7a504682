"""A stored inverted index, and exact top lists from it without scoring every match.

Postings are kept by leaf and term in blocks of ``BLOCK``, the ones of greatest effect first; a block
keeps its greatest term frequency and least document length, which bound what any of its postings
adds to a score. A query's terms are ordered by what they can add at most. The first blocks of
every term give lower bounds of some documents' scores, and the k-th best of these is a
score that the k-th best document reaches. A posting is followed only if it may be the strongest
term of a document that reaches it: its own part and the most that all weaker terms add must not
fall below. What is left are few (query, document) pairs; only they are shuffled, and their
scores are computed in full from the stored tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.text import word_tokens
from shelfspark.operators.ranks import spread_join, top_k
from shelfspark.session import materialise

K1, B = 1.2, 0.75
BLOCK = 128
#: The stored tokens of a product, in the order of their letters.
TOKENS = "tokens"
FIELDS = ("sku", "title", "description", "brand", "attributes_text")
SCHEMA = ("tenant string, term string, block int, best_tf long, least_dl int, "
          "postings array<struct<tf: long, dl: int, sku: string>>")
#: Scores are compared with this much room for rounding.
SLACK = 1e-8


def searchable_text(columns: Sequence[str] = FIELDS) -> Column:
    """The keyword fields of a stored product as one text."""
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in FIELDS if c in columns])


def with_tokens(rows: DataFrame) -> DataFrame:
    """Rows with the tokens of their searchable text."""
    return rows.withColumn(TOKENS, F.array_sort(word_tokens(searchable_text(rows.columns))))


def blocks(rows: DataFrame, leaf: Sequence[str]) -> DataFrame:
    """The postings of rows with ``tokens``, by leaf and term; a leaf has a bounded number of rows."""
    at = [*leaf, "term"]
    seen = rows.select(*leaf, "sku", F.size(TOKENS).alias("dl"), F.explode_outer(TOKENS).alias("term"))
    counted = seen.where(F.col("term").isNotNull()).groupBy(*at, "sku", "dl").agg(F.count("*").alias("tf"))
    # Greatest frequency first, then the shorter document.
    listed = counted.groupBy(*at).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("tf")).alias("tf"), "dl", "sku"))).alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / F.lit(BLOCK)).cast("int")),
                      lambda b: F.struct(b.alias("block"), F.transform(
                          F.slice("all", b * BLOCK + 1, F.lit(BLOCK)),
                          lambda p: F.struct((-p["tf"]).alias("tf"), p["dl"].alias("dl"),
                                             p["sku"].alias("sku"))).alias("postings")))
    return listed.select(*at, F.explode(cut).alias("c")).select(
        *at, F.col("c.block").alias("block"), F.col("c.postings")[0]["tf"].alias("best_tf"),
        F.array_min("c.postings.dl").alias("least_dl"), F.col("c.postings").alias("postings")).select(
        *leaf, "term", "block", "best_tf", "least_dl", "postings")


@dataclass(frozen=True)
class StoredIndex:
    """Postings, statistics per tenant (n_docs, n_tokens), and the tokens of each product."""

    postings: DataFrame
    stats: DataFrame
    documents: DataFrame


def part(idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term adds to a document's score."""
    tf = tf.cast("double")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def term_weights(terms: DataFrame, met: DataFrame, stats: DataFrame) -> DataFrame:
    """qid, tenant, term, idf, avgdl and ``weaker``: the most that a query's weaker terms add."""
    held = met.groupBy("tenant", "term").agg(
        F.sum(F.size("postings")).alias("df"), F.max("best_tf").alias("tf"), F.min("least_dl").alias("dl"))
    known = terms.join(held, ["tenant", "term"]).join(stats, "tenant").withColumns({
        "idf": F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)),
        "avgdl": F.col("n_tokens") / F.col("n_docs")})
    most = known.withColumn("most", part(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl")))
    before = W.partitionBy("qid").orderBy("most", "term").rowsBetween(W.unboundedPreceding, -1)
    return most.select("qid", "tenant", "term", "idf", "avgdl",
                       F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("weaker"))


@dataclass(frozen=True)
class Pruned:
    """Candidate pairs of a search, and its terms' weights."""

    candidates: DataFrame
    weights: DataFrame


def candidates(queries: DataFrame, index: StoredIndex, k: int, allowed: DataFrame | None = None) -> Pruned:
    """(tenant, qid, sku) of every document that may be among a query's k best.

    queries: qid, tenant, query, and ``scope`` if ``allowed`` (scope, sku) says which products count.
    """
    terms = queries.select("qid", "tenant", F.explode(F.array_distinct(word_tokens(F.col("query")))).alias("term"))
    asked = terms.select("tenant", "term").distinct()
    met = materialise(index.postings.join(asked, ["tenant", "term"], "left_semi"))
    weights = materialise(term_weights(terms, met, index.stats))
    spread = spread_join(met, weights, ["tenant", "term"], F.struct("block", "postings"))
    bounded = spread.withColumn("bound", part(F.col("idf"), F.col("best_tf"), F.col("least_dl"), F.col("avgdl")))

    def opened(held: DataFrame) -> DataFrame:
        rows = held.withColumn("p", F.explode("postings")).select(
            "tenant", "qid", "weaker", F.col("p.sku").alias("sku"),
            part(F.col("idf"), F.col("p.tf"), F.col("p.dl"), F.col("avgdl")).alias("part"),
            *[c for c in ("threshold",) if c in held.columns])
        if allowed is None:
            return rows
        scoped = rows.join(queries.select("qid", "scope"), "qid")
        return scoped.join(allowed.select("scope", "sku"), ["scope", "sku"], "left_semi").drop("scope")

    first = top_k(bounded, ["qid", "term"], [F.desc("bound"), F.asc("block")], 1 + -(-k // BLOCK))
    some = opened(first).groupBy("qid", "sku").agg(F.sum("part").alias("score"))
    reached = top_k(some, ["qid"], [F.desc("score")], k).where(F.col("rank") == k).select(
        "qid", F.col("score").alias("threshold"))
    told = bounded.join(reached, "qid", "left").withColumn(
        "threshold", F.coalesce(F.col("threshold") - SLACK, F.lit(0.0)))
    live = opened(told.where(F.col("bound") + F.col("weaker") >= F.col("threshold")))
    return Pruned(live.where(F.col("part") + F.col("weaker") >= F.col("threshold"))
                  .select("tenant", "qid", "sku").distinct(), weights)


def top_documents(queries: DataFrame, index: StoredIndex, k: int,
                  allowed: DataFrame | None = None) -> DataFrame:
    """The k best documents of every query by BM25: tenant, qid, sku, score, rank."""
    found = candidates(queries, index, k, allowed)
    of_query = found.weights.groupBy("qid").agg(
        F.collect_list(F.struct("term", "idf")).alias("weights"), F.first("avgdl").alias("avgdl"))
    pairs = found.candidates.join(of_query, "qid").join(index.documents, ["tenant", "sku"])
    dl = F.size(TOKENS)

    def added(total: Column, w: Column) -> Column:
        tf = F.size(F.filter(TOKENS, lambda t: t == w["term"]))
        return total + part(w["idf"], tf, dl, F.col("avgdl"))

    scored = pairs.select("tenant", "qid", "sku", F.round(
        F.aggregate("weights", F.lit(0.0), added), 9).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("sku")], k)
