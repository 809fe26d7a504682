"""Document quality by a factorisation machine.

Features are the hashed words of the whole text, as square roots of their shares; statistics of its
structure; and numeric metadata. The score is the logistic function of
``bias + x.w + 1/2 sum_f ((x.V_f)**2 - x**2.V_f**2)``: the sum-of-squares identity gives all pairwise
interactions in time linear in the features. It is fitted by Adam on at most ``TRAIN_ROWS`` labelled
rows, those of the smallest hashes of their ids, and applied to every document by array code.

Cases: null texts read as empty, and empty texts are scored by their structure alone; null metadata
reads as 0; ids with contradicting labels and null labels teach nothing; with fewer than two classes to learn
from every score is the share of label 1 (one half without any label); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.frames import free_name
from shelfspark.llm.spans import FOLDED, SPACE_BYTES, Piece, Rolling, pieces, runs

#: The bound of the labelled sample.
TRAIN_ROWS = 16_000
BUCKET_BITS = 12
FACTORS = 8
EPOCHS = 12
_TEXTS = 256
_BATCH = 128


def _share(flags: np.ndarray, edges: np.ndarray, whole: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return (sums[edges[1:]] - sums[edges[:-1]]) / whole


def features(piece: Piece, metadata: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per some hundred texts: square roots of the shares of hashed words, and statistics."""
    data, edges = piece.bytes, piece.edges
    starts, ends = runs(~SPACE_BYTES[data])
    bounds = piece.per_text(starts)
    hashes = Rolling(data, FOLDED).of(starts, ends)
    buckets = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    size = np.maximum(np.diff(edges) - 1, 1)
    words = np.diff(bounds)
    first, final = data[starts], data[ends - 1]
    alpha = ((data | 32) >= ord("a")) & ((data | 32) <= ord("z"))
    upper = alpha & (data < ord("a"))
    digit = (data >= ord("0")) & (data <= ord("9"))
    high = data >= 0x80
    mark = ~(alpha | digit | high | SPACE_BYTES[data])
    lines = _share(data == 10, edges, np.ones(len(piece)))
    lengths = ends - starts
    long_runs = np.zeros(len(data), bool)
    long_runs[1:] = mark[1:] & (data[1:] == data[:-1])
    of_words = np.maximum(words, 1)
    mean = _share(lengths, bounds, of_words)
    stats = [
        np.log1p(size), np.log1p(words), np.log1p(lines), words / lines, mean,
        np.sqrt(np.maximum(_share(lengths.astype(float) ** 2, bounds, of_words) - mean ** 2, 0)),
        _share(upper, edges, size), _share(digit, edges, size), _share(high, edges, size),
        _share(mark, edges, size), _share(long_runs, edges, size),
        _share(mark[starts], bounds, of_words), _share(mark[ends - 1], bounds, of_words),
        _share(final == ord("."), bounds, of_words),
        _share((first >= ord("A")) & (first <= ord("Z")), bounds, of_words),
        _share(lengths == 1, bounds, of_words), (words == 0).astype(float),
    ]
    known = np.nan_to_num(metadata.astype(float), nan=0.0)
    stats += [np.log1p(np.maximum(known[:, k], 0)) for k in range(known.shape[1])]
    for low in range(0, len(piece), _TEXTS):
        high_end = min(low + _TEXTS, len(piece))
        n, a, b = high_end - low, bounds[low], bounds[high_end]
        owner = np.repeat(np.arange(n), words[low:high_end])
        counts = np.bincount((owner << BUCKET_BITS) + buckets[a:b], minlength=n << BUCKET_BITS)
        counts = counts.reshape(n, 1 << BUCKET_BITS)
        again = np.zeros(b - a, bool)
        again[1:] = hashes[a:b][1:] == hashes[a:b][:-1]
        here = np.maximum(words[low:high_end], 1)
        repeats = [np.count_nonzero(counts, 1) / here, counts.max(1) / here,
                   np.bincount(owner, again, n) / here]
        yield (np.sqrt(counts / here[:, None]).astype(np.float32),
               np.stack([*(s[low:high_end] for s in stats), *repeats], 1))


class Machine:
    """Bias, weights, factors, and the scaling of the statistics."""

    def __init__(self, bias: float, width: int, stats: np.ndarray) -> None:
        self.bias = bias
        self.mean = stats.mean(0) if len(stats) else np.zeros(stats.shape[1])
        spread = stats.std(0) if len(stats) else np.ones(stats.shape[1])
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        random = np.random.default_rng(17)
        self.weights = np.zeros(width)
        self.factors = random.normal(0, 0.02, (width, FACTORS))

    def join(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """One row of inputs a text; statistics in standard deviations, within four of them."""
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / 4
        return np.concatenate((words, scaled.astype(np.float32)), 1)

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = x @ self.factors
        pairs = inner ** 2 - (x * x) @ (self.factors * self.factors)
        return self.bias + x @ self.weights + 0.5 * pairs.sum(1), inner

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray,
            epochs: int = EPOCHS, rate: float = 0.02, shrink: float = 1e-4) -> None:
        """Adam on the logistic loss; ``rows`` are (bucket, value) arrays of the words."""
        random = np.random.default_rng(5)
        names = ("bias", "weights", "factors")
        first = {n: np.zeros_like(np.asarray(getattr(self, n), float)) for n in names}
        second = {n: np.zeros_like(v) for n, v in first.items()}
        step = 0
        for epoch in range(epochs):
            order = random.permutation(len(rows))
            for low in range(0, len(rows), _BATCH):
                chosen = order[low:low + _BATCH]
                words = np.zeros((len(chosen), 1 << BUCKET_BITS), np.float32)
                for i, k in enumerate(chosen):
                    words[i, rows[k][0]] = rows[k][1]
                x = self.join(words, stats[chosen])
                raw, inner = self.raw(x)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
                slopes = {
                    "bias": error.sum(), "weights": error @ x + shrink * self.weights,
                    "factors": x.T @ (error[:, None] * inner)
                    - self.factors * (error @ (x * x))[:, None] + shrink * self.factors}
                step += 1
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * slopes[n]
                    second[n] = 0.999 * second[n] + 0.001 * slopes[n] ** 2
                    mean = first[n] / (1 - 0.9 ** step)
                    size = np.sqrt(second[n] / (1 - 0.999 ** step))
                    pace = rate * (1 - epoch / epochs)
                    setattr(self, n, getattr(self, n) - pace * mean / (size + 1e-8))


def _metadata(batch: pa.RecordBatch, piece: Piece, count: int, begin: int) -> np.ndarray:
    columns = [batch.column(begin + k).slice(piece.first, len(piece)).cast(pa.float64())
               .to_numpy(zero_copy_only=False) for k in range(count)]
    return np.stack(columns, 1) if columns else np.zeros((len(piece), 0))


def training_labels(labels: DataFrame, doc: str, label: str, limit: int = TRAIN_ROWS) -> DataFrame:
    """At most ``limit`` rows (doc, label): those of the smallest hashes of their ids."""
    agreed = (labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(doc).alias("doc")).agg(F.min(label).alias("low"), F.max(label).alias("high"))
              .where("low = high").select("doc", F.col("low").cast("int").alias("label")))
    return agreed.orderBy(F.xxhash64("doc"), "doc").limit(limit)


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text",
          label: str = "quality", metadata: tuple[str, ...] = ("n_chars",),
          limit: int = TRAIN_ROWS) -> Machine:
    """A machine fitted to the labelled rows given; the caller leaves out those held out."""
    count = len(metadata)
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"),
                       *[F.col(m).cast("double").alias(f"m{k}") for k, m in enumerate(metadata)])
    chosen = rows.join(F.broadcast(training_labels(labels, doc, label, limit)), "doc")
    schema = "label int, buckets array<int>, shares array<float>, stats array<double>"
    names = chosen.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taught = batch.column(names.index("label"))
            for piece in pieces(batch.column(names.index("text"))):
                at = piece.first
                for words, stats in features(piece, _metadata(batch, piece, count, names.index("text") + 1)):
                    found = [np.flatnonzero(w).astype(np.int32) for w in words]
                    yield pa.RecordBatch.from_arrays(
                        [taught.slice(at, len(words)), pa.array(found, pa.list_(pa.int32())),
                         pa.array([w[f] for w, f in zip(words, found)], pa.list_(pa.float32())),
                         pa.array(list(stats), pa.list_(pa.float64()))],
                        ["label", "buckets", "shares", "stats"])
                    at += len(words)

    sample = chosen.mapInArrow(work, schema).toArrow()
    width = len(sample["stats"][0]) if sample.num_rows else 0
    stats = (pc.list_flatten(sample["stats"]).to_numpy().reshape(-1, width) if width
             else np.zeros((0, 20 + count)))
    labels_of = sample["label"].to_numpy().astype(float)
    share = float(np.clip(labels_of.mean(), 0.001, 0.999)) if len(labels_of) else 0.5
    machine = Machine(float(np.log(share / (1 - share))), (1 << BUCKET_BITS) + stats.shape[1], stats)
    if 0 < labels_of.sum() < len(labels_of):
        lists = [[x.as_py() is not None and x.values.to_numpy() for x in sample[c]]
                 for c in ("buckets", "shares")]
        # The order of collected rows is not fixed; the sample's own content orders them.
        order = np.lexsort((*stats.T, labels_of))
        machine.fit([(lists[0][k], lists[1][k]) for k in order], stats[order], labels_of[order])
    else:
        machine.factors[:] = 0
    return machine


def with_score(docs: DataFrame, machine: Machine, text: str = "text", score: str = "score",
               metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The documents with the column ``score``, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    extra = [free_name(docs, f"m{k}") for k in range(len(metadata))]
    rows = docs.withColumns({e: F.col(m).cast("double") for e, m in zip(extra, metadata)})
    at, columns = docs.columns.index(text), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in pieces(batch.column(at)):
                scores = [model.score(model.join(words, stats)) for words, stats in
                          features(piece, _metadata(batch, piece, len(extra), columns))]
                part = batch.slice(piece.first, len(piece)).select(range(columns))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(scores))],
                                                 [*part.schema.names, score])

    return rows.mapInArrow(work, schema)


def held_out(doc: str, folds: int = 3) -> F.Column:
    """Whether a row is never learned from; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % folds == 1, F.lit(True))


def quality_report(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text",
                   label: str = "quality", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """Per document: held_out, score, predicted; learned from the rows that aren't held out."""
    machine = train(docs, labels.where(~held_out(doc)), doc, text, label, metadata)
    rows = docs.select(F.col(doc).alias("doc_id"), held_out(doc).alias("held_out"),
                       F.col(text).alias("text"), *metadata)
    return (with_score(rows, machine, "text", "score", metadata)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
            .select("doc_id", "held_out", "score", "predicted"))
