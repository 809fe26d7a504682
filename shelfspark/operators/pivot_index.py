"""An exact vector index: blocks of vectors around pivots, skipped by the triangle inequality.

Pivots are a bounded sample of each tenant's vectors. Every vector belongs to its nearest pivot;
the vectors of one pivot are cut into blocks of bounded size, each kept with its mean and the radius
around it. No vector of a block can have a greater product with a query than the mean's plus the
query's length times the radius. A query first meets the few blocks of greatest bound; the k-th best
score found there is reached by the k-th best of all, so only blocks whose bound reaches it follow.
Packs of queries meet packs of blocks, and only rows that reach their query's k-th best score leave
a task: pairs of query and block are never stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.ranks import spread_join, top_k
from shelfspark.session import materialise

PIVOTS, BLOCK_ROWS, FIRST_BLOCKS, QUERY_ROWS = 64, 2048, 2, 500
#: Heads of blocks, and rows of whole blocks, that travel as one.
HEADS, BUNDLE_ROWS = 2048, 4096
#: Room for rounding in bounds.
SLACK = 1e-7
_ASSIGNED = "tenant string, id string, v array<float>, cell int"
_BLOCKS = "tenant string, block string, centre array<double>, radius double, ids array<string>, vectors binary"
_FOUND = "tenant string, qid string, id string, score double"
_ASKED = "tenant string, qids array<string>, vectors binary, reached array<double>"
_BEGUN = "tenant string, qid string, block string, bound double"


@dataclass(frozen=True)
class PivotIndex:
    """Blocks of a table of vectors: tenant, block, centre, radius, ids, vectors."""

    blocks: DataFrame


def _matrix(values) -> np.ndarray:
    return np.asarray(list(values), dtype="float32").astype("float64")


def build(vectors: DataFrame, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> PivotIndex:
    """The index of vectors (tenant, id, v) of one width."""
    sample = top_k(vectors, ["tenant"], [F.xxhash64("id"), F.asc("id")], pivots)
    of_tenant = sample.groupBy("tenant").agg(F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("p")
                                             ).select("tenant", F.col("p.v").alias("pivots"))
    # A batch of rows travels with its tenant's pivots once, not once a row.
    batch = F.floor(F.monotonically_increasing_id() / F.lit(block_rows))
    packed = (vectors.select("tenant", "id", "v", batch.alias("batch")).groupBy("tenant", "batch")
              .agg(F.collect_list(F.struct("id", "v")).alias("rows")))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for tenant, rows, chosen in zip(frame["tenant"], frame["rows"], frame["pivots"], strict=True):
                own, centres = _matrix(r["v"] for r in rows), _matrix(chosen)
                far = (centres * centres).sum(1)[None, :] - 2 * own @ centres.T
                yield pd.DataFrame({"tenant": tenant, "id": [r["id"] for r in rows],
                                    "v": [r["v"] for r in rows], "cell": far.argmin(1)})

    placed = materialise(packed.join(of_tenant, "tenant").select("tenant", "rows", "pivots")
                         .mapInPandas(assign, _ASSIGNED))
    sizes = placed.groupBy("tenant", "cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("n"))
    cut = placed.join(sizes, ["tenant", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        own = _matrix(rows["v"])
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
        return pd.DataFrame([(key[0], f"{key[0]}/{key[1]}/{key[2]}", centre.tolist(), radius,
                              rows["id"].tolist(), own.astype("float32").tobytes())],
                            columns=["tenant", "block", "centre", "radius", "ids", "vectors"])

    return PivotIndex(materialise(cut.groupBy("tenant", "cell", "part").applyInPandas(pack, _BLOCKS)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda total, x: total + x)


def bounds(queries: DataFrame, index: PivotIndex) -> DataFrame:
    """tenant, qid, block and the greatest score that a vector of the block can have."""
    heads = index.blocks.select("tenant", "block", "centre", "radius")
    met = spread_join(heads, queries.select("tenant", "qid", "v"), ["tenant"], F.col("block"))
    length = F.sqrt(_dot(F.col("v"), F.col("v")))
    return met.select("tenant", "qid", "block", (_dot(F.col("v"), F.col("centre")) + length * F.col("radius")
                                                 + SLACK).alias("bound"))


def _scored(pairs: DataFrame, queries: DataFrame, index: PivotIndex, k: int, groups: int) -> DataFrame:
    """The k best rows of each block for each of its queries; a block meets bounded query groups."""
    asked = pairs.join(queries, ["tenant", "qid"]).groupBy(
        "block", F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("group")).agg(
        F.collect_list(F.struct("qid", "v")).alias("asked"))
    met = asked.join(index.blocks.select("tenant", "block", "ids", "vectors"), "block").select(
        "tenant", "asked", "ids", "vectors")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                ids = np.asarray(row.ids)
                wanted = _matrix(a["v"] for a in row.asked)
                held = np.frombuffer(row.vectors, "float32").reshape(len(ids), -1).astype("float64")
                for asked, line in zip(row.asked, np.round(wanted @ held.T, 9), strict=True):
                    near = np.arange(len(ids))
                    if len(line) > k:
                        near = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k])
                    best = near[np.lexsort((ids[near], -line[near]))[:k]]
                    yield pd.DataFrame({"tenant": row.tenant, "qid": asked["qid"], "id": ids[best],
                                        "score": line[best]})

    return met.mapInPandas(score, _FOUND)


def _asked(queries: DataFrame) -> DataFrame:
    """Queries (tenant, qid, v, reached) in packs of one tenant, without a shuffle."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for tenant, rows in frame.groupby("tenant"):
                for low in range(0, len(rows), QUERY_ROWS):
                    part = rows.iloc[low:low + QUERY_ROWS]
                    yield pd.DataFrame({
                        "tenant": [tenant], "qids": [part["qid"].tolist()],
                        "vectors": [np.asarray(part["v"].tolist(), "float32").tobytes()],
                        "reached": [part["reached"].fillna(-np.inf).tolist()]})

    return queries.select("tenant", "qid", "v", "reached").mapInPandas(pack, _ASKED)


def _bounds(wanted: np.ndarray, blocks) -> np.ndarray:
    centres = np.asarray([b["centre"] for b in blocks], "float64")
    radii = np.asarray([b["radius"] for b in blocks], "float64")
    return wanted @ centres.T + np.sqrt((wanted * wanted).sum(1))[:, None] * radii + SLACK


def _grouped(index: PivotIndex, groups: int, *fields: str) -> DataFrame:
    return index.blocks.groupBy("tenant", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("bundle")).agg(
        F.collect_list(F.struct(*fields)).alias("blocks"))


def _matrices(row) -> np.ndarray:
    return np.frombuffer(row.vectors, "float32").reshape(len(row.qids), -1).astype("float64")


def _first_blocks(asked: DataFrame, index: PivotIndex, n_blocks: int, first: int) -> DataFrame:
    """tenant, qid, block: the ``first`` blocks of greatest bound, from packs of heads."""
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                names = np.asarray([b["block"] for b in row.blocks])
                bound = _bounds(_matrices(row), row.blocks)
                at = np.argsort(-bound, axis=1, kind="stable")[:, :first]
                yield pd.DataFrame({"tenant": row.tenant, "qid": np.repeat(np.asarray(row.qids), at.shape[1]),
                                    "block": names[at.ravel()], "bound": np.take_along_axis(bound, at, 1).ravel()})

    heads = _grouped(index, -(-n_blocks // HEADS) or 1, "block", "centre", "radius")
    met = spread_join(asked, heads, ["tenant"], F.get("qids", F.lit(0)))
    found = met.select("tenant", "qids", "vectors", "blocks").mapInPandas(best, _BEGUN)
    return top_k(found, ["tenant", "qid"], [F.desc("bound"), F.asc("block")], first).drop("rank", "bound")


def _reaching(asked: DataFrame, index: PivotIndex, n_blocks: int, block_rows: int, k: int) -> DataFrame:
    """Rows whose score reaches what their query has reached, k at most of each pack of blocks."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                wanted, reached = _matrices(row), np.asarray(row.reached)
                open_ = (_bounds(wanted, row.blocks) >= reached[:, None]).any(0)
                kept = [b for b, use in zip(row.blocks, open_, strict=True) if use]
                if not kept:
                    continue
                ids = np.concatenate([np.asarray(b["ids"]) for b in kept])
                held = np.frombuffer(b"".join(b["vectors"] for b in kept), "float32").reshape(len(ids), -1)
                scores = wanted @ held.astype("float64").T
                floor = reached
                if len(ids) > k:
                    # Where too little is known, the pack's own k-th best score cuts.
                    vague = np.flatnonzero((scores >= reached[:, None] - SLACK).sum(1) > k)
                    floor = reached.copy()
                    floor[vague] = np.partition(scores[vague], len(ids) - k, axis=1)[:, len(ids) - k]
                    floor = np.maximum(floor, reached)
                query, at = np.nonzero(scores >= floor[:, None] - SLACK)
                found = pd.DataFrame({"tenant": row.tenant, "qid": np.asarray(row.qids)[query], "id": ids[at],
                                      "score": np.round(scores[query, at], 9)})
                # Rows that tie at the cut leave by their id, as in the list itself.
                found = found.sort_values(["qid", "score", "id"], ascending=[True, False, True])
                yield found.groupby("qid").head(k)

    bundles = _grouped(index, -(-n_blocks * block_rows // BUNDLE_ROWS) or 1, "centre", "radius", "ids", "vectors")
    met = spread_join(bundles, asked, ["tenant"], F.col("bundle"))
    return met.select("tenant", "qids", "vectors", "reached", "blocks").mapInPandas(score, _FOUND)


@dataclass(frozen=True)
class Nearest:
    """The k nearest (tenant, qid, id, score, rank); pairs of query and block, and those visited,
    which are worked out when they are asked for."""

    hits: DataFrame
    pairs: Callable[[], DataFrame]
    visited: Callable[[], DataFrame]


def nearest(queries: DataFrame, index: PivotIndex, k: int, first: int = FIRST_BLOCKS) -> Nearest:
    """Exact nearest rows by dot product of queries (tenant, qid, v) within their tenant; ties by id."""
    keys, best = ["tenant", "qid"], [F.desc("score"), F.asc("id")]
    queries = materialise(queries.select("tenant", "qid", "v"))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    n_blocks, rows = index.blocks.agg(F.count("*"), F.avg(F.size("ids"))).first()
    asked = _asked(queries.withColumn("reached", F.lit(None).cast("double")))
    begun = materialise(_first_blocks(asked, index, n_blocks, first))
    near = top_k(_scored(begun, queries, index, k, groups), keys, best, k)
    reached = materialise(queries.join(near.where(F.col("rank") == k).select(
        *keys, F.col("score").alias("reached")), keys, "left"))
    hits = top_k(_reaching(_asked(reached), index, n_blocks, max(1, round(rows or 1)), k), keys, best, k)

    def visited() -> DataFrame:
        known = reached.select(*keys, "reached").join(begun.groupBy(*keys).agg(
            F.collect_set("block").alias("begun")), keys, "left")
        return bounds(queries, index).join(known, keys).where(
            F.col("reached").isNull() | (F.col("bound") >= F.col("reached"))
            | F.array_contains("begun", F.col("block"))).select(*keys, "block")

    return Nearest(hits, lambda: bounds(queries, index), visited)


def skipped(found: Nearest) -> DataFrame:
    """Pairs of query and block, how many were visited, and the share that was skipped."""
    counts = found.pairs().agg(F.count("*").alias("pairs")).crossJoin(
        F.broadcast(found.visited().agg(F.count("*").alias("visited"))))
    return counts.withColumn("skipped", 1 - F.try_divide("visited", "pairs"))
