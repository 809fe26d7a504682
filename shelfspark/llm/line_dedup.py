"""Line deduplication across documents with two Bloom filters.

A line's key is the line without white space at both ends and with A-Z lower-cased. A key of at
least ``min_chars`` code points that at least two documents hold is kept in the document of the
smallest id only. Pass one fills, per task, a filter of keys seen once and one of keys seen twice,
a document's own repeats counted once; the tasks' filters are merged slice by slice, where whatever
two of them have in common counts as seen twice. The merged twice-seen filter has no false
negatives. Pass two shuffles only the keys in it, as 128-bit digests, pre-aggregated to the smallest
and the largest id, which differ exactly if two documents hold the key. Pass three drops the lines.

The filters' size follows the number of lines up to ``max_bits``; beyond that they only fill up, so
that more keys are suspected and confirmed or cleared by the exact step.

Cases: null and empty texts are one empty line; rows of one id are one document, and all keep what
that id is first to hold; rows without an id are left as they are and count for nothing; further
columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.frames import free_name, written
from shelfspark.llm.spans import FOLDED, LOWER, SPACE_BYTES, Piece, Rolling, agree, pieces

MIN_CHARS = 10
#: Bits of the filters for each line, and at most.
BITS_PER_LINE = 16
MAX_BITS = 1 << 29
_SLICE_BITS = 1 << 23
_LEAST_BITS = 1 << 16


class Lines:
    """The lines of a piece: bounds, key bounds, whether the key counts, key hashes."""

    def __init__(self, piece: Piece, min_chars: int) -> None:
        data = piece.bytes
        self.ends = np.flatnonzero(data == 10)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends
        self.bounds = piece.per_text(self.starts)
        solid = np.append(np.flatnonzero(~SPACE_BYTES[data]), len(data))
        first = np.searchsorted(solid, self.starts)
        last = np.searchsorted(solid, self.ends)
        filled = last > first
        self.key_starts = np.where(filled, solid[first], self.starts)
        self.key_ends = np.where(filled, solid[last - 1] + 1, self.starts)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.counts = chars[self.key_ends] - chars[self.key_starts] >= min_chars
        self.data, self.letters = data, LOWER[data]
        self.lower = self.letters.tobytes()

    @cached_property
    def hashes(self) -> np.ndarray:
        return Rolling(self.data, FOLDED).of(self.key_starts, self.key_ends)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Index and text of one line for each counting key of each text."""
        index = np.flatnonzero(self.counts)
        owner = np.searchsorted(self.bounds, index, "right") - 1
        order = np.lexsort((self.hashes[index], owner))
        index, owner = index[order], owner[order]
        fresh = np.ones(len(index), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (self.hashes[index[1:]] != self.hashes[index[:-1]])
        # A line that only shares its hash with the first of its run is named as well.
        first = index[np.maximum.accumulate(np.where(fresh, np.arange(len(index)), 0))]
        fresh |= ~agree(self.letters, self.key_starts[index], self.key_ends[index],
                        self.key_starts[first], self.key_ends[first])
        return index[fresh], owner[fresh]

    def digest(self, i: int) -> bytes:
        key = self.lower[self.key_starts[i]:self.key_ends[i]]
        return hashlib.blake2b(key, digest_size=16).digest()


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(34)) & mask).astype(np.int64)


def _has(filled: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    found = np.ones(len(places[0]), bool)
    for p in places:
        found &= (filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return found


def _put(filled: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(filled, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))


def filter_bits(docs: DataFrame, text: str, bits_per_line: int = BITS_PER_LINE,
                max_bits: int = MAX_BITS) -> int:
    """A power of two of about ``bits_per_line`` for every line of the table."""
    size = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    lines = docs.agg(F.sum(size)).first()[0] or 0
    return int(min(max_bits, max(_LEAST_BITS, 1 << (lines * bits_per_line).bit_length())))


def twice_seen(docs: DataFrame, doc: str, text: str, bits: int, min_chars: int) -> np.ndarray:
    """The filter of keys that two documents may hold, as packed bits; at most MAX_BITS."""
    width = min(bits, _SLICE_BITS) // 8
    slices = bits // 8 // width

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                lines = Lines(piece, min_chars)
                keys, counts = np.unique(lines.hashes[lines.distinct()[0]], return_counts=True)
                places = _places(keys, bits)
                again = _has(once, places) | (counts > 1)
                _put(twice, tuple(p[again] for p in places))
                _put(once, places)
        for k in range(slices):
            cut = slice(k * width, (k + 1) * width)
            if once[cut].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()),
                     pa.array([zlib.compress(once[cut].tobytes(), 1)], pa.binary()),
                     pa.array([zlib.compress(twice[cut].tobytes(), 1)], pa.binary())],
                    ["slice", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if k in merged:
                    once, twice = merged[k]
                    twice |= b | (once & a)
                    once |= a
                else:
                    merged[k] = (a.copy(), b.copy())
        for k, (_, twice) in merged.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())],
                ["slice", "twice"])

    local = (docs.where(F.col(doc).isNotNull()).select(text)
             .mapInArrow(fill, "slice int, once binary, twice binary"))
    found = np.zeros(bits // 8, np.uint8)
    parts = local.repartition(min(slices, 64), "slice").mapInArrow(merge, "slice int, twice binary")
    for row in parts.toLocalIterator():
        found[row["slice"] * width:(row["slice"] + 1) * width] = np.frombuffer(
            zlib.decompress(row["twice"]), np.uint8)
    return found


def lines_to_drop(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                  min_chars: int = MIN_CHARS, bits_per_line: int = BITS_PER_LINE,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """Per document that loses lines: ``doc_id`` and ``gone``, the digests of the keys it loses."""
    spark = docs.sparkSession
    bits = filter_bits(docs, text, bits_per_line, max_bits)
    shared = spark.sparkContext.broadcast(
        zlib.compress(twice_seen(docs, doc, text, bits, min_chars).tobytes(), 1))
    kind = docs.schema[doc].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            for piece in pieces(batch.column(1)):
                lines = Lines(piece, min_chars)
                index, owner = lines.distinct()
                maybe = _has(twice, _places(lines.hashes[index], bits))
                if maybe.any():
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner[maybe] + piece.first)),
                         pa.array([lines.digest(i) for i in index[maybe].tolist()], pa.binary())],
                        ["doc_id", "key"])

    held = written(docs.where(F.col(doc).isNotNull()).select(doc, text)
                   .mapInArrow(suspects, f"doc_id {kind}, key binary"), "line-suspects")
    # Written, so that both sides of the join have their own exchange and a hot key can be split.
    repeated = written(held.groupBy("key").agg(F.min("doc_id").alias("first_doc"),
                                               F.max("doc_id").alias("last_doc"))
                       .where("first_doc <> last_doc").select("key", "first_doc"), "line-repeats")
    return (held.join(repeated, "key").where(F.col("doc_id") != F.col("first_doc"))
            .groupBy("doc_id").agg(F.collect_set("key").alias("gone")))


def _kept(texts: pa.Array, gone: pa.Array, min_chars: int) -> Iterator[tuple[int, int, bytes]]:
    """Per text: lines, dropped lines, and the kept lines."""
    for piece in pieces(texts):
        lines = Lines(piece, min_chars)
        raw = piece.bytes.tobytes()
        dropped = gone.slice(piece.first, len(piece)).to_pylist()
        for k in range(len(piece)):
            a, b = int(lines.bounds[k]), int(lines.bounds[k + 1])
            if not dropped[k]:
                yield b - a, 0, raw[piece.edges[k]:piece.edges[k + 1] - 1]
                continue
            away = set(dropped[k])
            kept = [raw[lines.starts[i]:lines.ends[i]] for i in range(a, b)
                    if not (lines.counts[i] and lines.digest(i) in away)]
            yield b - a, b - a - len(kept), b"\n".join(kept)


def _with_drops(docs: DataFrame, doc: str, text: str, gone: str, min_chars: int) -> DataFrame:
    drops = lines_to_drop(docs, doc, text, min_chars)
    key = free_name(docs, "doc")
    drops = drops.select(F.col("doc_id").alias(key), F.col("gone").alias(gone))
    return docs.join(drops, docs[doc] == drops[key], "left").drop(key)


def dedup_report(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: n_lines, n_dropped, kept_sha256."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    marked = _with_drops(rows, "doc_id", "text", "gone", min_chars)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_kept(batch.column(1), batch.column(2), min_chars))
            if found:
                n_lines, n_dropped, kept = zip(*((a, b, hashlib.sha256(c).hexdigest())
                                                 for a, b, c in found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                     pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(report, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with their kept lines as text; every row stays, null texts stay null."""
    gone = free_name(docs, "gone")
    marked = _with_drops(docs, doc, text, gone, min_chars)
    marked = marked.select(*[F.col(f"`{c}`") for c in docs.columns], gone)
    at, columns = docs.columns.index(text), len(docs.columns)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            was = batch.column(at)
            kept = [c.decode() if n else w for (_, n, c), w in
                    zip(_kept(was, batch.column(columns), min_chars), was.to_pylist())]
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array(kept, field.type)).select(range(columns))

    return marked.mapInArrow(shorten, T.StructType(docs.schema.fields))
