"""Benchmark decontamination by windows of normalised words.

A text is lower-cased in A-Z and cut into words of digits, a-z and every character above 0x7F. The
windows of a benchmark item are its runs of ten words; an item of one to nine words is one window
of its own length. The windows form a hash set that is broadcast, in slices of a bounded number of
windows; each slice is one pass over the documents, without any shuffle. Up to ``AT_ONCE`` passes are
chained in one plan, so a task holds that many slices at most; then the documents are written. A
document's windows of each length in the set are hashed from running sums, looked up in a bitmap
and then in the set, and every hit is compared word by word with the window it matched.

Cases: null and empty texts have no words and are never hit; items without words or without an id
are ignored; repeated items and repeated documents are each treated alone; any number of words per
text; further columns of the documents pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.frames import free_name, written
from shelfspark.llm.spans import FOLDED, LOWER, Piece, Rolling, pieces, window_starts

WINDOW = 10
#: Windows in one broadcast: some 100 MB with their words.
SLICE_WINDOWS = 500_000
AT_ONCE = 4
_BITS = 20

_HITS = T.ArrayType(T.StructType([
    T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType()),
    T.StructField("items", T.ArrayType(T.StringType()))]))


def _texts_of(piece: Piece, starts: np.ndarray, ends: np.ndarray, first: np.ndarray,
              size: int) -> list[bytes]:
    """The words first .. first+size-1, lower-cased and joined by one space."""
    lower = LOWER[piece.bytes].tobytes()
    return [b" ".join([lower[a:b] for a, b in zip(starts[i:i + size].tolist(),
                                                  ends[i:i + size].tolist())])
            for i in first.tolist()]


def _word_hashes(piece: Piece) -> tuple[np.ndarray, np.ndarray, Rolling]:
    starts, ends = piece.words()
    return starts, ends, Rolling(Rolling(piece.bytes, FOLDED).of(starts, ends))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                      size: int = WINDOW) -> DataFrame:
    """The distinct windows: ``words`` (joined by a space), ``size``, ``hash``, ``items``."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                ids = batch.column(0).slice(piece.first, len(piece)).to_pylist()
                starts, ends, rolling = _word_hashes(piece)
                bounds = piece.per_text(starts)
                for i, name in enumerate(ids):
                    count = int(bounds[i + 1] - bounds[i])
                    width = min(size, count)
                    if not width:
                        continue
                    first = np.arange(bounds[i], bounds[i + 1] - width + 1)
                    found = _texts_of(piece, starts, ends, first, width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.binary()), pa.array([width] * len(found), pa.int32()),
                         pa.array(rolling.of(first, first + width).view(np.int64)),
                         pa.array([name] * len(found), pa.string())],
                        ["words", "size", "hash", "item"])

    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string"), text)
    return (rows.mapInArrow(windows, "words binary, size int, hash long, item string")
            .groupBy("words", "size", "hash").agg(F.sort_array(F.collect_set("item")).alias("items")))


class WindowSet:
    """A slice of the windows, as broadcast: words and items by window, hashes by length."""

    def __init__(self, rows: list) -> None:
        self.items = {bytes(r["words"]): r["items"] for r in rows}
        self.hashes = {}
        for size in sorted({r["size"] for r in rows}):
            values = np.array([r["hash"] for r in rows if r["size"] == size], np.int64).view(np.uint64)
            self.hashes[size] = np.unique(values)

    def bitmaps(self) -> dict[int, np.ndarray]:
        maps = {}
        for size, values in self.hashes.items():
            maps[size] = np.zeros(1 << _BITS, bool)
            maps[size][values >> np.uint64(64 - _BITS)] = True
        return maps


def _hits(piece: Piece, known: WindowSet, bitmaps: dict[int, np.ndarray]) -> list[list[dict]]:
    starts, ends, rolling = _word_hashes(piece)
    bounds = piece.per_text(starts)
    found: list[list[dict]] = [[] for _ in range(len(piece))]
    for size, values in known.hashes.items():
        first = window_starts(bounds, size)
        hashes = rolling.of(first, first + size)
        likely = np.flatnonzero(bitmaps[size][hashes >> np.uint64(64 - _BITS)])
        hashes = hashes[likely]
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        first = first[likely[values[at] == hashes]]
        owner = np.searchsorted(bounds, first, "right") - 1
        for i, k, words in zip(first.tolist(), owner.tolist(),
                               _texts_of(piece, starts, ends, first, size)):
            items = known.items.get(words)
            if items is not None:
                found[k].append({"first_word": i - int(bounds[k]), "words": size, "items": items})
    return found


def window_slices(windows: DataFrame, limit: int = SLICE_WINDOWS) -> Iterator[list]:
    """The windows in lists of about ``limit``, each small enough to broadcast."""
    kept = written(windows, "windows")
    slices = max(1, -(-kept.count() // limit))
    for k in range(slices):
        yield kept.where(F.pmod("hash", F.lit(slices)) == k).collect()


def with_hits(docs: DataFrame, benchmark: DataFrame, hits: str, text: str = "text",
              size: int = WINDOW, limit: int = SLICE_WINDOWS) -> DataFrame:
    """Documents with the column ``hits``: every occurrence of a window and its items."""
    spark = docs.sparkSession
    schema = T.StructType([*docs.schema.fields, T.StructField(hits, _HITS)])
    out = docs.withColumn(hits, F.array().cast(_HITS))
    at = docs.columns.index(text)
    for k, rows in enumerate(window_slices(benchmark_windows(benchmark, size=size), limit)):
        if k and k % AT_ONCE == 0:
            out = written(out, "hits")
        shared = spark.sparkContext.broadcast(WindowSet(rows))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            bitmaps = known.bitmaps()
            for batch in batches:
                last = batch.num_columns - 1
                for piece in pieces(batch.column(at)):
                    part = batch.slice(piece.first, len(piece))
                    new = _hits(piece, known, bitmaps)
                    if any(new):
                        both = [a + b for a, b in zip(part.column(last).to_pylist(), new)]
                        part = part.set_column(last, part.schema.field(last),
                                               pa.array(both, part.schema.field(last).type))
                    yield part

        out = out.mapInArrow(scan, schema)
    return out


def hit_report(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
               size: int = WINDOW, limit: int = SLICE_WINDOWS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    base = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    marked = with_hits(base, benchmark, "hits", "text", size, limit)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                counts = np.diff(piece.per_text(piece.words()[0]))
                hits = batch.column(2).slice(piece.first, len(piece)).to_pylist()
                n_hit = [covered(h) for h in hits]
                items = [sorted({i for hit in h for i in hit["items"]}) for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(piece)), pa.array(counts, pa.int64()),
                     pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                     pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                     pa.array([n > 0 for n in n_hit])],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, "
                                     "items_sha256 string, contaminated boolean")


def covered(hits: list[dict]) -> int:
    """Words inside any of the hits."""
    return sum(b - a for a, b in stretches(hits))


def stretches(hits: list[dict]) -> list[tuple[int, int]]:
    """The hits as disjoint stretches of words, in order."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted((h["first_word"], h["first_word"] + h["words"]) for h in hits):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                  remove: str = "documents", size: int = WINDOW) -> DataFrame:
    """The documents without contamination, in their own columns.

    ``remove`` is "documents" (every document with a hit goes) or "spans" (each hit stretch of
    words, from its first to its last character, is cut out of the text).
    """
    hits = free_name(docs, "hits")
    marked = with_hits(docs, benchmark, hits, text, size)
    if remove == "documents":
        return marked.where(F.size(hits) == 0).drop(hits)
    if remove != "spans":
        raise ValueError(f"unknown removal {remove!r}")
    at, columns = docs.columns.index(text), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(at)):
                part = batch.slice(piece.first, len(piece))
                starts, ends = piece.words()
                bounds = piece.per_text(starts)
                texts = part.column(at).to_pylist()
                for k, found in enumerate(part.column(columns).to_pylist()):
                    if not found:
                        continue
                    raw, base = texts[k].encode(), int(piece.edges[k])
                    kept, cursor = [], 0
                    for a, b in stretches(found):
                        kept.append(raw[cursor:int(starts[bounds[k] + a]) - base])
                        cursor = int(ends[bounds[k] + b - 1]) - base
                    texts[k] = b"".join([*kept, raw[cursor:]]).decode()
                field = part.schema.field(at)
                part = part.set_column(at, field, pa.array(texts, field.type))
                yield part.select(range(columns))

    return marked.mapInArrow(cut, docs.schema)
