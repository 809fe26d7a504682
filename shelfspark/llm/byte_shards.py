"""Shards of equal bytes by histogram sort.

Rows are ordered by an integer key (then by a digest of the text, then by their place in the written
table, so that no two rows are equal). Splitters are found without sorting: each round counts the
exact bytes and rows below a set of candidate boundaries in every partition, adds the counts, and
keeps for each splitter the two boundaries around its target. The next candidates divide what lies
between them, from the least to the greatest key that is really there, so outlying keys cost one
round. It ends when every splitter meets its tolerance or a single row stands between its
boundaries. Then the rows are exchanged once, each to its piece of a shard; the place of a row in
its shard is the exact count below the piece plus its place in the piece.

The driver holds candidates and their counts only: their number follows from the number of pieces,
at most ``MOST_PIECES``. A shard has at least ``PIECES`` pieces, so no task sorts a whole one.

Cases: a null text is empty and a row has one byte more than its text; null keys come first, equal
keys (and copies of one row) may be parted by a splitter; one row larger than a shard fills it and
leaves its neighbours empty; an empty table gives no rows; further columns pass through, except one
named as the shard or slot column, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.frames import free_name, written

SHARDS = 16
#: Share of a shard's bytes by which a splitter between shards may miss its target.
TOLERANCE = 1 / 2048
#: Candidate boundaries of a round over all splitters, and the fewest for one splitter.
PROBES, LEAST_PROBES = 1024, 4
PIECES, PIECE_ROWS, MOST_PIECES = 4, 1 << 20, 1 << 16
_WIDTH = 24
_SIGN = np.uint64(1 << 63)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The first three columns, longs, as byte strings in the same order."""
    whole = np.empty((batch.num_rows, 3), ">u8")
    for i in range(3):
        whole[:, i] = batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) ^ _SIGN
    return whole.view(f"S{_WIDTH}").ravel()


def _strings(numbers: list[int]) -> np.ndarray:
    return np.array([n.to_bytes(_WIDTH, "big") for n in numbers], f"S{_WIDTH}")


@dataclass
class Bins:
    """Between candidates i-1 and i: what lies below, and the least and greatest key there."""

    edges: list[int]
    bytes_below: list[int]
    rows_below: list[int]
    ranges: list[tuple[int, int] | None]


def _counted(keyed: DataFrame, size: str, edges: list[int]) -> Bins:
    """Exact bytes and rows below each edge; ``keyed`` starts with the three key columns."""
    shared = keyed.sparkSession.sparkContext.broadcast(_strings(edges))
    at = keyed.columns.index(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = shared.value
        total, rows = np.zeros((2, len(probes) + 1), np.int64)
        least: dict[int, bytes] = {}
        most: dict[int, bytes] = {}
        for batch in batches:
            keys = _keys(batch)
            order = np.argsort(keys)
            keys = keys[order]
            sums = np.concatenate(([0], np.cumsum(batch.column(at).to_numpy()[order])))
            cuts = np.concatenate(([0], np.searchsorted(keys, probes), [len(keys)]))
            total += np.diff(sums[cuts])
            rows += np.diff(cuts)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                first, last = (bytes(keys[k]).ljust(_WIDTH, b"\0") for k in (cuts[i], cuts[i + 1] - 1))
                least[i] = min(least.get(i, first), first)
                most[i] = max(most.get(i, last), last)
        filled = sorted(least)
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled, pa.int32()), pa.array(total[filled], pa.int64()),
             pa.array(rows[filled], pa.int64()),
             pa.array([least[i] for i in filled], pa.binary()),
             pa.array([most[i] for i in filled], pa.binary())],
            ["bin", "bytes", "rows", "least", "most"])

    found = (keyed.mapInArrow(work, "bin int, bytes long, rows long, least binary, most binary")
             .groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
                                 F.min("least").alias("least"), F.max("most").alias("most"))
             .collect())
    shared.unpersist()
    total, rows = [0] * (len(edges) + 2), [0] * (len(edges) + 2)
    ranges: list[tuple[int, int] | None] = [None] * (len(edges) + 1)
    for b in found:
        total[b["bin"] + 1], rows[b["bin"] + 1] = b["bytes"], b["rows"]
        ranges[b["bin"]] = tuple(int.from_bytes(bytes(b[k]), "big") for k in ("least", "most"))
    return Bins(edges, np.cumsum(total).tolist(), np.cumsum(rows).tolist(), ranges)


def _between(low: int, high: int, n: int) -> list[int]:
    """About n boundaries that divide the keys low..high, none of them empty on the left."""
    step = max(1, (high - low) // (n + 1))
    return [*range(low + step, high, step)][:n] + [high]


@dataclass
class Splitters:
    """Piece i holds the keys from ``edges[i-1]`` on, below ``edges[i]``."""

    edges: list[int]
    #: Rows of the whole table before piece i.
    rows_below: list[int]
    rounds: int


def find_splitters(keyed: DataFrame, size: str, pieces: int, tight: int,
                   tolerance: float = TOLERANCE, probes: int = PROBES) -> Splitters:
    """Boundaries of ``pieces`` equal parts in bytes; each ``tight``-th is a boundary of shards, whose
    tolerance is a share of a shard; the others may miss by a quarter of a piece."""
    bins = _counted(keyed, size, [])
    total = bins.bytes_below[-1]
    targets = [total * i / pieces for i in range(1, pieces)]
    slack = [tolerance * total * tight / pieces if (i + 1) % tight == 0 else total / pieces / 4
             for i in range(len(targets))]
    known: dict[int, tuple[int, int]] = {}
    spread = max(LEAST_PROBES, probes // max(1, len(targets)))
    waiting = list(range(len(targets))) if total else []
    rounds = 0
    while True:
        below = np.array(bins.bytes_below)
        fresh: dict[int, int] = {}
        still = []
        for t in waiting:
            # The bin with the target: between its edges as far as they are known.
            i = min(int(np.searchsorted(below, targets[t], "right")), len(below) - 1) - 1
            near = min(targets[t] - below[i], below[i + 1] - targets[t])
            if (rounds and near <= slack[t]) or bins.ranges[i][0] == bins.ranges[i][1]:
                continue
            still.append(t)
            fresh[i] = fresh.get(i, 0) + spread
        waiting = still
        if not waiting:
            break
        edges = set()
        for i, n in fresh.items():
            # A bin that many splitters share gets the candidates of all of them.
            low, high = bins.ranges[i]
            edges.update([low, *_between(low, high, n), high + 1])
        bins = _counted(keyed, size, sorted(edges))
        rounds += 1
        known.update(zip(bins.edges, zip(bins.bytes_below[1:], bins.rows_below[1:])))
    chosen = _nearest(known, targets, bins.rows_below[-1], total)
    return Splitters([e for e, _ in chosen], [0, *(r for _, r in chosen)], rounds)


def _nearest(known: dict[int, tuple[int, int]], targets: list[float], rows: int,
             total: int) -> list[tuple[int, int]]:
    """For each target the boundary whose bytes below are nearest; the ends count as boundaries."""
    marks = sorted([(0, 0, 0), (total, (1 << 8 * _WIDTH) - 1, rows),
                    *((b, e, r) for e, (b, r) in known.items())])
    below = np.array([m[0] for m in marks])
    out = []
    for target in targets:
        i = int(np.searchsorted(below, target))
        if i == len(below) or i and target - below[i - 1] <= below[i] - target:
            i -= 1
        out.append(marks[i][1:])
    return out


def shard_rows(rows: DataFrame, key: str, size: str, tie: F.Column, shards: int = SHARDS,
               tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS, shard: str = "shard",
               slot: str = "slot") -> DataFrame:
    """The rows with their shard (int) and their place in it (long, gapless from 0).

    ``size`` names a positive long column; ``tie`` orders rows of one key as far as it can.
    """
    rows = rows.drop(shard, slot)
    names = [free_name(rows, k) for k in ("key", "tie", "row", "piece", "base")]
    low = F.lit(-(1 << 63)).cast("long")
    keyed = rows.select(F.coalesce(F.col(key).cast("long"), low).alias(names[0]),
                        F.coalesce(tie.cast("long"), low).alias(names[1]),
                        F.monotonically_increasing_id().alias(names[2]), "*")
    keyed = written(keyed, "shards")
    narrow = keyed.select(*names[:3], size)
    count = narrow.count()
    tight = max(PIECES, min(MOST_PIECES // shards, -(-count // (shards * piece_rows))))
    found = find_splitters(narrow, size, shards * tight, tight, tolerance)
    shared = keyed.sparkSession.sparkContext.broadcast(
        (_strings(found.edges), np.array(found.rows_below)))
    schema = T.StructType([*keyed.schema.fields, T.StructField(names[3], T.IntegerType()),
                           T.StructField(shard, T.IntegerType()), T.StructField(names[4], T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, before = shared.value
        for batch in batches:
            piece = np.searchsorted(edges, _keys(batch), "right")
            own = piece // tight
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(piece, pa.int32()), pa.array(own, pa.int32()),
                 pa.array(before[piece] - before[own * tight], pa.int64())],
                [*batch.schema.names, names[3], shard, names[4]])

    inside = Window.partitionBy(names[3]).orderBy(*names[:3])
    return (keyed.mapInArrow(place, schema)
            .withColumn(slot, F.col(names[4]) + F.row_number().over(inside) - 1)
            .drop(*names))


def _sized(docs: DataFrame, text: str, size: str) -> DataFrame:
    return docs.withColumn(size, (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE,
                    doc: str = "doc_id", text: str = "text", piece_rows: int = PIECE_ROWS,
                    shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The documents in key order, in shards of equal bytes."""
    size = free_name(docs, "size")
    return shard_rows(_sized(docs, text, size), doc, size, F.xxhash64(text), shards, tolerance,
                      piece_rows, shard, slot).drop(size)


def write_shards(docs: DataFrame, path: str, shard: str = "shard") -> None:
    """Placed documents as one folder of Parquet files for each shard, written piece by piece."""
    docs.write.partitionBy(shard).parquet(path)


def shard_report(docs: DataFrame, shards: int = SHARDS, doc: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Per document: size, text_crc32, law (``bytes``), shard, slot; grown_shard is null."""
    rows = docs.select(
        F.col(doc).alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return (shard_rows(rows, "doc_id", "size", F.col("text_crc32"), shards)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
