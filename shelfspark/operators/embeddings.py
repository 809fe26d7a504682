"""Embedding quality and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.ranks import SALTS, spread_join, top_k

_SUMS = "grp string, n long, squares double, total array<double>"
_BLOCK = "tenant string, ids array<string>, width int, vectors binary"
_NEIGHBOURS = "tenant string, qid string, id string, score double"
QUERY_BLOCK_ROWS = 1_000


def vector_sums(rows: DataFrame, group: Column, vector: str = "embedding") -> DataFrame:
    """Per group: row count, sum of squared lengths and the vector sum.

    Every task reduces its batches to one row per group before anything is shuffled.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for grp, part in batch.groupby("grp", dropna=False):
                matrix = np.asarray(part["v"].tolist(), dtype="float64")
                out.append((grp, len(part), float((matrix * matrix).sum()),
                            matrix.sum(axis=0).tolist()))
            yield pd.DataFrame(out, columns=["grp", "n", "squares", "total"])

    partials = rows.select(group.cast("string").alias("grp"), F.col(vector).alias("v")
                           ).where(F.col("grp").isNotNull()).mapInPandas(partial, _SUMS)
    places = partials.select("grp", F.posexplode("total").alias("at", "x")).groupBy(
        "grp", "at").agg(F.sum("x").alias("x"))
    lengths = places.groupBy("grp").agg(F.sum(F.col("x") * F.col("x")).alias("norm2"))
    sizes = partials.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    return sizes.join(lengths, "grp")


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def pairwise_similarity(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean similarity over all distinct pairs, without forming a pair.

    The dot products of all pairs add up to half of |sum of vectors|^2 minus the squared
    lengths, so one pass gives the exact mean; fewer than two rows give 0.
    """
    sums = vector_sums(rows, F.lit("all"), vector)
    mean = F.try_divide((F.col("norm2") - F.col("squares")) / 2, _pairs(F.col("n")))
    return sums.select("n", F.coalesce(mean, F.lit(0.0)).alias("mean_similarity"))


def group_contrast(rows: DataFrame, group: Column, vector: str = "embedding",
                   pair_cap: int | None = None) -> DataFrame:
    """Mean similarity within groups against across groups, over all pairs.

    ``pair_cap`` weighs a group by at most that many pairs, as a capped sample of pairs
    would. No row when fewer than two groups have two members.
    """
    keyed = rows.withColumn("_grp", group.cast("string"))
    groups = vector_sums(keyed.where(F.col("_grp") != ""), F.col("_grp"), vector).where(
        F.col("n") >= 2)
    sizes = groups.select(F.col("grp").alias("_grp"))
    grouped = keyed.join(sizes, "_grp", "left_semi")
    whole = vector_sums(grouped, F.lit("all"), vector).select(
        F.col("n").alias("_n"), F.col("squares").alias("_sq"), F.col("norm2").alias("_norm2"))
    pairs = _pairs(F.col("n"))
    weight = pairs if pair_cap is None else F.least(pairs, F.lit(float(pair_cap)))
    dots = (F.col("norm2") - F.col("squares")) / 2
    within = groups.agg(
        F.count("*").alias("groups_compared"), F.sum(weight).alias("n_within"),
        F.sum(dots / pairs * weight).alias("_within"), F.sum(dots).alias("_dots"),
        F.sum(pairs).alias("_pairs"))
    both = within.crossJoin(F.broadcast(whole))
    across_pairs = _pairs(F.col("_n")) - F.col("_pairs")
    across = ((F.col("_norm2") - F.col("_sq")) / 2 - F.col("_dots")) / across_pairs
    means = both.where((F.col("groups_compared") >= 2)).select(
        "groups_compared", F.col("n_within").cast("long").alias("n_within_pairs"),
        across_pairs.cast("long").alias("n_across_pairs"),
        (F.col("_within") / F.col("n_within")).alias("within_mean"), across.alias("across_mean"))
    return means.withColumn("contrast", F.col("within_mean") - F.col("across_mean"))


def _pack(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (tenant, id, v) as blocks of vectors, without a shuffle."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tenant, part in batch.groupby("tenant"):
                for start in range(0, len(part), block_rows):
                    piece = part.iloc[start:start + block_rows]
                    matrix = np.asarray(piece["v"].tolist(), dtype="float32")
                    yield pd.DataFrame([(tenant, piece["id"].tolist(), matrix.shape[1],
                                         matrix.tobytes())],
                                       columns=["tenant", "ids", "width", "vectors"])

    return rows.mapInPandas(pack, _BLOCK)


def knn_topk(queries: DataFrame, corpus: DataFrame, k: int, salts: int = SALTS,
             exclude_self: bool = False) -> DataFrame:
    """Exact k nearest rows of each query's tenant by dot product: (tenant, qid, id, score, rank).

    queries: tenant, qid, v. corpus: tenant, id, v. Query vectors travel in packed blocks
    to the corpus blocks of their tenant (salted, so a large tenant is spread); each pair of
    blocks is one matrix product that keeps k rows per query, ties by id.
    """
    query_blocks = _pack(queries.select("tenant", F.col("qid").alias("id"), "v"),
                         QUERY_BLOCK_ROWS).select(
        "tenant", F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    corpus_blocks = _pack(corpus.select("tenant", "id", "v"), QUERY_BLOCK_ROWS * 4)
    met = spread_join(corpus_blocks, query_blocks, ["tenant"], F.get("ids", F.lit(0)), salts)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                order = np.argsort(np.asarray(row.ids), kind="stable")
                ids = np.asarray(row.ids)[order]
                matrix = np.frombuffer(row.vectors, "float32").reshape(-1, row.width)[order]
                wanted = np.frombuffer(row.qvectors, "float32").reshape(-1, row.width)
                scores = np.round(wanted.astype("float64") @ matrix.astype("float64").T, 9)
                n, keep = len(ids), k + 1 if exclude_self else k
                taken = np.ones(scores.shape, bool)
                if n > keep:
                    cut = np.partition(scores, n - keep, axis=1)[:, n - keep, None]
                    taken, ties = scores > cut, scores == cut
                    # Of equal scores the first ids.
                    taken |= ties & (np.cumsum(ties, axis=1) <= keep - taken.sum(1, keepdims=True))
                query, at = np.nonzero(taken)
                yield pd.DataFrame({"tenant": row.tenant, "qid": np.asarray(row.qids)[query], "id": ids[at],
                                    "score": scores[query, at]})

    near = met.mapInPandas(score, _NEIGHBOURS)
    if exclude_self:
        near = near.where(F.col("qid") != F.col("id"))
    return top_k(near, ["tenant", "qid"], [F.desc("score"), F.asc("id")], k)
