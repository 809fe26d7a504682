"""Lloyd's algorithm with the dimensions sharded.

Vectors are kept by column blocks: a row of the written table holds the components of one column
block for a chunk of vectors. In a round each column block computes its exact partial distances to
its slice of the centroids; the partial distances of a chunk are added over its blocks and the least
taken; the choice goes back to the blocks, and each block's cluster sums give the new values of its
own slice. All arithmetic is on integers.

The centroids (clusters times dimensions, both parameters) are the only thing the driver holds. A
chunk has a bounded number of vectors, so no group grows with the data. Rounds start from the
written blocks and the former centroids: nothing else has to survive a lost executor.

Cases: vectors that are null, of another length, or with a null or non-finite component are left
out; a vector without an id takes part but starts no centroid; equal hashes start in the order of
their components; fewer vectors than clusters give fewer clusters; an empty table gives no rows;
repeated rows count each; further columns are ignored. A component is held to 2**26 in magnitude
(an input of 262,144), so that distances fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.frames import written

CLUSTERS, ROUNDS, DIMENSIONS = 40, 5, 64
#: Column blocks, and vectors of a chunk.
BLOCKS, CHUNK = 4, 1024
LARGEST = 1 << 26
_EXACT = float(1 << 53)


def whole_vectors(vectors: DataFrame, column: str) -> F.Column:
    """True for vectors without a null or non-finite component."""
    def fine(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return F.coalesce(F.col(column).isNotNull() & F.forall(column, fine), F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite numbers, held to the largest magnitude."""
    return np.clip(np.floor(values.astype(np.float64) * 256), -LARGEST, LARGEST)


def partitions_for(rows: int, chunk: int) -> int:
    """Partitions of up to 16 chunks, but 64 at least where there are chunks for them."""
    chunks = -(-rows // chunk)
    return max(1, min(chunks, 64), -(-chunks // 16))


def _blocks(kept: DataFrame, rows: int, dimensions: int, blocks: int, chunk: int) -> DataFrame:
    """(chunk, block, n, ids, part): components of a column block, row by row; ids with the first."""
    edges = np.linspace(0, dimensions, blocks + 1).astype(int).tolist()
    kind = kept.schema["vec_id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("block", T.IntegerType()),
        T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("part", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                own = batch.slice(start, chunk)
                vectors = integers(own.column(1).flatten().to_numpy()).astype(np.int32)
                vectors = vectors.reshape(own.num_rows, dimensions)
                ids = pa.ListArray.from_arrays(
                    pa.array([0, *[own.num_rows] * blocks], pa.int32()), own.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * blocks, pa.int64()), pa.array(range(blocks), pa.int32()),
                     pa.array([own.num_rows] * blocks, pa.int32()), ids,
                     pa.array([vectors[:, a:b].tobytes() for a, b in zip(edges, edges[1:])],
                              pa.binary())], schema.names)
                number += 1

    return kept.repartition(partitions_for(rows, chunk)).mapInArrow(work, schema)


def partial_distances(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances in the dimensions of one block, in the narrowest integers."""
    part, centres = part.astype(np.int64), centres.astype(np.int64)
    reach = float(max(np.abs(part).max(initial=0), np.abs(centres).max(initial=0)))
    bound = 4 * reach * reach * part.shape[1]
    if bound < _EXACT:  # every sum is a whole number that doubles hold
        cross = (part.astype(np.float64) @ centres.T.astype(np.float64)).astype(np.int64)
    else:
        cross = part @ centres.T
    found = (part * part).sum(1)[:, None] - 2 * cross + (centres * centres).sum(1)[None, :]
    return found.astype(np.int32) if bound < 2**31 else found


def _sum_blocks(rows: list[bytes], sizes: int, clusters: int) -> np.ndarray:
    total = np.zeros((sizes, clusters), np.int64)
    for raw in rows:
        kind = np.int32 if len(raw) == 4 * total.size else np.int64
        total += np.frombuffer(raw, kind).reshape(total.shape)
    return total


class Lloyd:
    """The written blocks, and the steps of a round over them."""

    def __init__(self, table: DataFrame, dimensions: int, blocks: int) -> None:
        self.table = table
        self.edges = np.linspace(0, dimensions, blocks + 1).astype(int).tolist()
        self.id_kind = table.schema["ids"].dataType.elementType

    def nearest(self, centres: np.ndarray, with_ids: bool = False) -> DataFrame:
        """(chunk, own, [ids], far): each vector's cluster and squared distance, by chunks."""
        shared = self.table.sparkSession.sparkContext.broadcast(centres)
        edges, clusters = self.edges, len(centres)
        ids = [T.StructField("ids", T.ArrayType(self.id_kind))] if with_ids else []
        head = [T.StructField("chunk", T.LongType()), *ids]
        parts = T.StructType([*head, T.StructField("n", T.IntegerType()),
                              T.StructField("found", T.BinaryType())])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chunk, block, n, ids, part = batch.columns
                for i in range(batch.num_rows):
                    a, b = edges[block[i].as_py()], edges[block[i].as_py() + 1]
                    own = np.frombuffer(part[i].as_buffer(), np.int32).reshape(-1, b - a)
                    found = partial_distances(own, shared.value[:, a:b])
                    # A row at a time: partial distances are wider than what they come from.
                    yield pa.RecordBatch.from_arrays(
                        [chunk.slice(i, 1), *[ids.slice(i, 1)] * with_ids, n.slice(i, 1),
                         pa.array([found.tobytes()], pa.binary())], parts.names)

        def least(group: pa.Table) -> pa.Table:
            n = group.column("n")[0].as_py()
            total = _sum_blocks(group.column("found").to_pylist(), n, clusters)
            own = total.argmin(1)
            far = total[np.arange(n), own]
            columns = {"chunk": pa.array([group.column("chunk")[0].as_py()], pa.int64())}
            if with_ids:
                lists = group.column("ids").combine_chunks()
                keep = [i for i, x in enumerate(lists) if len(x) == n][:1]
                columns["ids"] = lists.take(pa.array(keep, pa.int64()))
            columns["own"] = pa.array([own.astype(np.int32)], pa.list_(pa.int32()))
            columns["far"] = pa.array([far], pa.list_(pa.int64()))
            return pa.table(columns)

        chosen = T.StructType([*head, T.StructField("own", T.ArrayType(T.IntegerType())),
                               T.StructField("far", T.ArrayType(T.LongType()))])
        return self.table.mapInArrow(partial, parts).groupBy("chunk").applyInArrow(least, chosen)

    def moved(self, centres: np.ndarray) -> np.ndarray:
        """The centroids after one round: floored means, empty clusters as they were."""
        edges, clusters = self.edges, len(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((clusters, edges[-1]), np.int64)
            count = np.zeros((clusters, edges[-1]), np.int64)
            for batch in batches:
                for block, raw, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                           batch.column(2)):
                    a, b = edges[block], edges[block + 1]
                    own = own.values.to_numpy()
                    part = np.frombuffer(raw, np.int32).reshape(-1, b - a).astype(np.int64)
                    order = np.argsort(own, kind="stable")
                    firsts = np.flatnonzero(np.diff(own[order], prepend=-1))
                    total[own[order][firsts], a:b] += np.add.reduceat(part[order], firsts)
                    count[:, a:b] += np.bincount(own, minlength=clusters)[:, None]
            cluster, dimension = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster, pa.int32()), pa.array(dimension, pa.int32()),
                 pa.array(total[cluster, dimension]), pa.array(count[cluster, dimension])],
                ["cluster", "dimension", "total", "n"])

        back = self.table.select("chunk", "block", "part").join(
            self.nearest(centres).select("chunk", "own"), "chunk").select("block", "part", "own")
        slices = (back.mapInArrow(sums, "cluster int, dimension int, total long, n long")
                  .groupBy("cluster", "dimension").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
                  .select("cluster", "dimension", F.expr("(t - pmod(t, n)) div n").alias("value")))
        new = centres.copy()
        for row in slices.toLocalIterator():  # clusters x dimensions rows at most
            new[row["cluster"], row["dimension"]] = row["value"]
        return new


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS,
          dimensions: int = DIMENSIONS, vec: str = "vec_id", column: str = "embedding",
          blocks: int = BLOCKS, chunk: int = CHUNK, start: str = "2:") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    blocks = min(blocks, dimensions)
    kept = (vectors.filter(whole_vectors(vectors, column) & (F.size(column) == dimensions))
            .select(F.col(vec).alias("vec_id"), F.col(column).alias("v")))
    rank = F.sha2(F.concat(F.lit(start), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = (kept.filter(F.col("vec_id").isNotNull()).withColumn("rank", rank)
             .orderBy("rank", "v").limit(clusters).select("v").collect())
    kind = vectors.schema[vec].dataType.simpleString()
    schema = (f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, "
              "centroid_sha256 string")
    if not first:
        return spark.createDataFrame([], schema)
    centres = integers(np.array([r["v"] for r in first])).astype(np.int64)
    table = written(_blocks(kept, kept.count(), dimensions, blocks, chunk), "blocks")
    steps = Lloyd(table, dimensions, blocks)
    for _ in range(rounds):
        centres = steps.moved(centres)
    placed = written(
        steps.nearest(centres, with_ids=True)
        .select(F.explode(F.arrays_zip("ids", "own", "far")).alias("r"))
        .select(F.col("r.ids").alias("vec_id"), F.col("r.own").alias("cluster"),
                F.col("r.far").alias("distance")), "clusters")
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centres.tolist()]
    per = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    # As many rows as clusters, a parameter.
    sums = per.join(named, "cluster").crossJoin(per.agg(F.sum("cluster_inertia").alias("inertia")))
    return placed.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
