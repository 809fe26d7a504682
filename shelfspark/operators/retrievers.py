"""Retrieval engines behind one interface, and their comparison on one golden set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.vectors import hashed_embedder
from shelfspark.operators import pivot_index
from shelfspark.operators.evaluation import macro_columns, score_queries
from shelfspark.operators.search import search_catalog
from shelfspark.sources.catalog import CatalogTable

HIT = ["qid", "tenant", "sku", "rank", "score"]


@runtime_checkable
class Retriever(Protocol):
    """An engine over a stored catalog. Hits are of the query's tenant only, whoever asks."""

    name: str

    def search(self, queries: DataFrame, catalog: CatalogTable, limit: int) -> DataFrame:
        """The first ``limit`` hits of queries (qid, tenant, query): qid, tenant, sku, rank, score."""
        ...

    def health(self, catalog: CatalogTable) -> bool:
        """Whether the engine can serve from this catalog."""
        ...


@dataclass
class HybridRetriever:
    """Keyword index and vectors, blended; options as ``search`` takes them."""

    name: str = "hybrid"
    options: dict = field(default_factory=dict)

    def search(self, queries: DataFrame, catalog: CatalogTable, limit: int) -> DataFrame:
        asked = queries.withColumn("limit", F.lit(limit))
        return search_catalog(asked, catalog, **self.options).select(*HIT)

    def health(self, catalog: CatalogTable) -> bool:
        return catalog.exists() and catalog.indexed and "embedding" in catalog.scan().columns


@dataclass
class PivotRetriever:
    """Stored embeddings in blocks around pivots; the index is built once for each snapshot."""

    name: str = "pivot"
    embedder: object = None
    pivots: int = pivot_index.PIVOTS
    block_rows: int = pivot_index.BLOCK_ROWS
    _built: dict = field(default_factory=dict, repr=False)

    def index(self, catalog: CatalogTable) -> pivot_index.PivotIndex:
        at = (catalog.path, catalog.snapshot().number)
        if at not in self._built:
            vectors = catalog.scan(columns=["tenant", "sku", "embedding"]).where("embedding IS NOT NULL")
            # Emptied, not replaced: engines that differ in their queries only may share it.
            self._built.clear()
            self._built[at] = pivot_index.build(vectors.select(
                "tenant", F.col("sku").alias("id"), F.col("embedding").alias("v")), self.pivots, self.block_rows)
        return self._built[at]

    def search(self, queries: DataFrame, catalog: CatalogTable, limit: int) -> DataFrame:
        embed = self.embedder or hashed_embedder()
        asked = queries.select("tenant", "qid", embed("query").alias("v"))
        hits = pivot_index.nearest(asked, self.index(catalog), limit).hits
        return hits.select("qid", "tenant", F.col("id").alias("sku"), "rank", "score")

    def health(self, catalog: CatalogTable) -> bool:
        return catalog.exists() and "embedding" in catalog.scan().columns


def rankings(engines: Sequence[Retriever], queries: DataFrame, catalog: CatalogTable,
             limit: int = 50) -> DataFrame:
    """The hits of every engine, with its name as ``engine``."""
    return reduce(DataFrame.unionByName, [
        e.search(queries, catalog, limit).withColumn("engine", F.lit(e.name)) for e in engines])


def compare(engines: Sequence[Retriever], queries: DataFrame, judgments: DataFrame, catalog: CatalogTable,
            limit: int = 50) -> DataFrame:
    """Per engine the mean of every metric over the golden queries."""
    found = rankings(engines, queries, catalog, limit)
    scores = score_queries(queries.select("qid", "tenant"), found, judgments, by=["engine"])
    return scores.groupBy("engine").agg(*macro_columns())
