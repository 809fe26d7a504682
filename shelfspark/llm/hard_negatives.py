"""Hard negatives by rotated one-bit codes with residual intervals.

Vectors are integers, rotated by a signed Hadamard transform (exact on integers; it multiplies every
product by the number of dimensions). A rotated vector y is stored as signs s1 with its alignment
to them, a1 = mean |y|; what is left, y - a1 s1, is coded the same way, ``CODES`` times over. With a
query as a few bit planes, popcounts give its product with each code, so the sum of a_k <q, s_k>
estimates the score; by Cauchy and Schwarz it is off by at most |q| times the length of the last
residual, less the part of q along the last code, plus the rounding of the planes. These intervals
hold always: a row is dropped after a code if its interval can't reach what the anchor still needs,
and the rows left after the last code are scored on integers.

Anchors meet all rows in blocks: the rows are packed once, in blocks of bounded size, with their
codes; each block of anchors is sent to every slice of row blocks. A task keeps the best rows of one
anchor block in one slice and gives back a few rows for each anchor. The first pass finds the
positives, the second the negatives between the limits that the positives' scores set.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part; shorter
vectors are read as if zeros followed; repeated rows count each as partners, but an anchor id that
several rows hold is taken from the least label, then the least vector, and a row of the anchor's
own id is never its positive; a positive score below zero leaves no room for negatives; an empty
table, or one without anchors, gives no rows; further columns are ignored. A component is held to
2**26 in magnitude, so that scores fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.frames import written
from shelfspark.llm.sharded_kmeans import integers, partitions_for, whole_vectors

ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LEAST_PERCENT, MOST_PERCENT = 50, 95
CODES, PLANES = 4, 6
#: Rows of a row block, rows looked at together, anchors of an anchor block, row blocks of a slice.
ROWS, STRIP, ANCHORS, SLICE = 5000, 2500, 512, 32
_EXACT = float(1 << 53)
_WORD = 64


def width_for(dimensions: int) -> int:
    """The next power of two, a word of bits at least."""
    return max(_WORD, 1 << max(0, dimensions - 1).bit_length())


def rotated(vectors: np.ndarray) -> np.ndarray:
    """The vectors times random signs, then Hadamard transformed; exact for integers."""
    n, width = vectors.shape
    y = vectors.astype(np.float64) * np.random.default_rng(20).choice([-1.0, 1.0], width)
    half = 1
    while half < width:
        y = y.reshape(n, -1, 2, half)
        y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, width)
        half *= 2
    return y


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(np.uint64)


def _bits(words: np.ndarray) -> np.ndarray:
    """Set bits over the last axis."""
    found = np.bitwise_count(words)
    return found[..., 0].astype(np.int64) if words.shape[-1] == 1 else found.sum(-1, dtype=np.int64)


@dataclass
class RowBlock:
    """Rows sorted by label with their codes; ``signs`` has an axis of words last."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    signs: np.ndarray
    aligned: np.ndarray
    left: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> RowBlock:
        order = np.argsort(labels, kind="stable")
        rest = rotated(vectors[order])
        length = np.sqrt((rest * rest).sum(1))
        signs, aligned, left = [], [], []
        for _ in range(CODES):
            up = rest >= 0
            a = np.abs(rest).mean(1)
            rest = rest - a[:, None] * np.where(up, 1.0, -1.0)
            signs.append(_packed(up))
            aligned.append(a)
            left.append(np.sqrt((rest * rest).sum(1)))
        return cls(ids[order], labels[order], vectors[order].astype(np.int32), np.array(signs),
                   np.array(aligned), np.array(left), length)

    def columns(self) -> list[pa.Array]:
        return [pa.array([getattr(self, f.name).tobytes()], pa.binary()) for f in fields(self)]

    @classmethod
    def read(cls, raw: list[bytes]) -> RowBlock:
        ids, labels = (np.frombuffer(raw[i], np.int64) for i in (0, 1))
        n = len(ids)
        vectors = np.frombuffer(raw[2], np.int32).reshape(n, -1)
        signs = np.frombuffer(raw[3], np.uint64).reshape(CODES, n, -1)
        aligned, left = (np.frombuffer(raw[i], np.float64).reshape(CODES, n) for i in (4, 5))
        return cls(ids, labels, vectors, signs, aligned, left, np.frombuffer(raw[6], np.float64))

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products of some rows with an anchor."""
        rows = self.vectors[at]
        reach = float(np.abs(rows).max(initial=0)) * float(np.abs(anchor).max(initial=0))
        if reach * len(anchor) < _EXACT:
            return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
        return rows.astype(np.int64) @ anchor.astype(np.int64)


_ROW_COLUMNS = ", ".join(f"{f.name} binary" for f in fields(RowBlock))


class Probe:
    """An anchor as bit planes: y is ``low + step * u`` but for a known rounding."""

    def __init__(self, y: np.ndarray) -> None:
        self.low = float(y.min())
        self.step = (float(y.max()) - self.low) / ((1 << PLANES) - 1) or 1.0
        u = np.rint((y - self.low) / self.step).astype(np.int64)
        planed = self.low + self.step * u
        self.planes = _packed(((u >> np.arange(PLANES)[:, None]) & 1).astype(bool))
        self.constant = -self.step * float(u.sum()) - self.low * len(y)
        self.square = float(planed @ planed)
        self.rounding = float(np.sqrt(((y - planed) ** 2).sum()))
        self.length = float(np.sqrt(y @ y))
        self.width = len(y)

    def product(self, signs: np.ndarray) -> np.ndarray:
        """With signs as +1 and -1, by popcounts."""
        total = 2 * self.low * _bits(signs)
        for b in range(PLANES):
            total = total + (2 * self.step * (1 << b)) * _bits(signs & self.planes[b])
        return total + self.constant

    def within(self, block: RowBlock, at: np.ndarray, least: float, most: float) -> np.ndarray:
        """Of the rows ``at``, those whose score may lie between ``least`` and ``most``."""
        guess = np.zeros(len(at))
        for k in range(CODES):
            along = self.product(block.signs[k][at])
            guess = guess + block.aligned[k][at] * along
            across = np.sqrt(np.maximum(0.0, self.square - along * along / self.width))
            length = block.length[at]
            room = across * block.left[k][at] + (self.rounding + 1e-9 * self.length) * length
            keep = (guess + room >= least * self.width) & (guess - room <= most * self.width)
            at, guess = at[keep], guess[keep]
            if len(at) == 0:
                break
        return at


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties by id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class Found:
    """The best rows so far for each anchor and list; how many rows were scored, and met."""

    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    scored: int = 0
    met: int = 0

    def add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        old = self.best.get(key, _NONE)
        self.best[key] = first_of(np.concatenate((old[0], scores)), np.concatenate((old[1], ids)), k)

    def last(self, key: tuple[int, int], k: int) -> float:
        """The k-th best score, below which nothing more is needed."""
        scores = self.best.get(key, _NONE)[0]
        return float(scores[k - 1]) if len(scores) >= k else -np.inf


def _strips(start: int, end: int) -> Iterator[np.ndarray]:
    for s in range(start, end, STRIP):
        yield np.arange(s, min(end, s + STRIP))


def find_positives(anchors: dict, block: RowBlock, found: Found) -> None:
    """The first rows of each anchor's label, without its own id."""
    for i, (own, label, vector) in enumerate(
            zip(anchors["own_ids"], anchors["own_labels"], anchors["own_vectors"])):
        start, end = np.searchsorted(block.labels, (label, label + 1))
        key = (i, 0)
        for at in _strips(start, end):
            found.met += len(at)
            at = anchors["probes"][i].within(block, at, found.last(key, POSITIVES), np.inf)
            at = at[block.ids[at] != own]
            found.scored += len(at)
            found.add(key, block.scores(at, vector), block.ids[at], POSITIVES)


def limits(score: int) -> tuple[int, int]:
    """Least and greatest score of a negative of a positive with this score."""
    return -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100


def find_negatives(anchors: dict, block: RowBlock, found: Found) -> None:
    """For each positive of an anchor the first rows of another label between its limits."""
    for i, (label, vector) in enumerate(zip(anchors["own_labels"], anchors["own_vectors"])):
        bounds = [limits(s) for s in anchors["scores"][i]]
        if not any(a <= b for a, b in bounds):
            continue
        most = max(b for a, b in bounds if a <= b)
        for at in _strips(0, len(block.ids)):
            # A list that is full needs only what reaches its last score.
            least = min(max(a, found.last((i, j), NEGATIVES)) for j, (a, b) in enumerate(bounds) if a <= b)
            found.met += len(at)
            at = anchors["probes"][i].within(block, at, least, most)
            at = at[block.labels[at] != label]
            found.scored += len(at)
            scores, ids = block.scores(at, vector), block.ids[at]
            for j, (a, b) in enumerate(bounds):
                fits = (scores >= a) & (scores <= b)
                if fits.any():
                    found.add((i, j), scores[fits], ids[fits], NEGATIVES)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of integers, filled up with zeros."""
    flat = integers(column.flatten().to_numpy(zero_copy_only=False))
    sizes = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    found[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return found


def _row_blocks(rows: DataFrame, count: int, width: int, size: int) -> DataFrame:
    parts = partitions_for(count, size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                own = batch.slice(start, size)
                block = RowBlock.of(own.column(0).to_numpy(), own.column(1).to_numpy(),
                                    _matrix(own.column(2), width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), *block.columns()], ["slice", *_NAMES])
                number += parts

    return (rows.repartition(parts)
            .mapInArrow(work, f"slice long, {_ROW_COLUMNS}"))


_NAMES = [f.name for f in fields(RowBlock)]


def _read_anchors(raw: dict, width: int) -> dict:
    """Anchors of a block: ids, labels, vectors, their probes and the lists of their positives."""
    vectors = np.zeros((len(raw["own_ids"]), width))
    for i, v in enumerate(raw["own_vectors"]):
        vectors[i, :len(v)] = integers(np.array(v))
    return raw | {"own_vectors": vectors.astype(np.int64), "probes": [Probe(y) for y in rotated(vectors)]}


def _meet(anchors: DataFrame, blocks: DataFrame, slices: int, width: int,
          find: Callable[[dict, RowBlock, Found], None]) -> DataFrame:
    """(anchor_id, list, id, score): best rows of every anchor in every slice.

    ``anchors`` has a row for each block: columns of lists, block first.
    """
    names = anchors.columns
    spread = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    sliced = blocks.withColumn("slice", (F.col("slice") % slices).cast("int"))
    # Anchors stream, the row blocks of a slice are held.
    pairs = spread.hint("merge").join(sliced, "slice").select("slice", *names, *_NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block_of, found = None, {}, Found({})

        def rows() -> pa.RecordBatch:
            keys = [(block_of["own_ids"][i], j, n, s) for (i, j), (scores, ids) in found.best.items()
                    for s, n in zip(scores.tolist(), ids.tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[c] for k in keys], kind) for c, kind in enumerate(
                    (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor_id", "list", "id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                key = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
                if key != current:
                    # Pairs of one block and slice follow each other; what is known of them goes on.
                    if current is not None:
                        yield rows()
                    if current is None or current[1] != key[1]:
                        block_of = _read_anchors({n: batch.column(1 + c)[r].as_py()
                                                  for c, n in enumerate(names)}, width)
                    current, found = key, Found({})
                find(block_of, RowBlock.read([batch.column(1 + len(names) + c)[r].as_buffer()
                                              for c in range(len(_NAMES))]), found)
        if current is not None:
            yield rows()

    return pairs.mapInArrow(work, "anchor_id long, list int, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of every anchor and list over all slices, with their rank."""
    order = Window.partitionBy("anchor_id", "list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _anchor_blocks(anchors: DataFrame, count: int, *more: str) -> DataFrame:
    """A row for each block of anchors; blocks are ranges of the ids' hashes."""
    blocks = -(-count // ANCHORS)
    named = {"own_ids": "vec_id", "own_labels": "label", "own_vectors": "v"} | {m: m for m in more}
    held = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(n) for n, c in named.items()])))
    return (anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
            .agg(held.alias("held"))
            .select("block", *[F.col(f"held.{n}").alias(n) for n in named]))


def hard_negatives(vectors: DataFrame, vec: str = "vec_id", label: str = "label",
                   column: str = "embedding", every: int = ANCHOR_EVERY,
                   relabel: int = RELABEL_EVERY, rows: int = ROWS) -> DataFrame:
    """Per anchor and positive up to three negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    own = F.col(label).cast("long")
    kept = vectors.filter(F.col(vec).isNotNull() & F.col(label).isNotNull()
                          & whole_vectors(vectors, column)).select(
        F.col(vec).cast("long").alias("vec_id"),
        F.when(F.col(vec) % relabel == 0, (own + 1) % LABELS).otherwise(own).alias("label"),
        F.col(column).alias("v"))
    of_anchor = F.col("vec_id") % every == 0
    size = kept.agg(F.count("*"), F.max(F.size("v")), F.count_if(of_anchor)).first()
    width = width_for(size[1] or 1)
    blocks = written(_row_blocks(kept, size[0], width, rows), "vector_blocks")
    slices = max(1, min(-(-size[0] // rows), 32), -(-size[0] // (rows * SLICE)))
    # One anchor an id; an anchor's partners stay as they are.
    anchors = (kept.filter(of_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s"))
               .select("vec_id", "s.label", "s.v"))
    count = max(1, size[2])
    positives = written(_first(_meet(_anchor_blocks(anchors, count), blocks, slices, width,
                                     find_positives), POSITIVES), "positives")
    lists = positives.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    scored = (anchors.join(lists, anchors["vec_id"] == lists["anchor_id"])
              .select("vec_id", "label", "v", F.col("p.score").alias("scores")))
    negatives = _first(_meet(_anchor_blocks(scored, count, "scores"), blocks, slices, width,
                             find_negatives), NEGATIVES)
    named = positives.select("anchor_id", (F.col("rank") - 1).alias("list"),
                             F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (negatives.join(named, ["anchor_id", "list"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
