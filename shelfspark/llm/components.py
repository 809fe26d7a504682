"""Connected components of an edge table by alternating star operations.

Both operations look at a node's smallest neighbour only, found by an aggregate that combines before
it shuffles, so no list of neighbours is ever built. Each round is written to the shared folder, from
where its joins read both sides: a node that many edges meet can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.frames import written


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with ``m``, the least node that a's edges lead to."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    return edges.join(least, "a")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` for every node with an edge; the root is the least node it reaches.

    Nulls and loops are ignored, repeated and reversed edges change nothing, no edges give no rows.
    """
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    known = written(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "edges")
    before = None
    while True:
        # Large star: every larger neighbour moves to the least of a's neighbours and a.
        both = written(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                       "edges")
        wide = _with_least(both).where("b > a").select(
            F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        # Small star: a and its smaller neighbours move to the least of them.
        wide = written(wide, "edges")
        near = _with_least(wide)
        known = written(near.select("a", F.col("m").alias("b")).unionByName(
            near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = known.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = known.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
