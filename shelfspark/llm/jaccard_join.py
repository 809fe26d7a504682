"""Near-duplicate documents by a Jaccard join of word five-grams with Bayesian pruning.

A text's words are lower-cased in A-Z; its set holds the hashes of its runs of five words, of all
its words if they are fewer. Texts of equal sets are copies and go through the join as one node.

1. Signatures of MinHash values are cut into bands; nodes that share a band are candidates. At a
   similarity of 0.8 a pair shares none of them with a probability of 3e-6.
2. Nodes connected by candidacy meet in tiles: a small group is one of several in a tile, a large one
   is cut into blocks, and a pair of blocks is a tile: for all their nodes in a group in which most
   share bands, else for those nodes that share a band with a node of the other block. Nothing is
   emitted per pair.
3. In a tile only pairs that share a band are compared, ``STEP`` values at a time; a pair is dropped as soon as the
   posterior probability (uniform prior) of a similarity of ``threshold`` falls below
   ``TOLERANCE``. Those that remain are verified exactly by products of their sets' incidences.
4. A tile reports for each node its links and the least node it is linked with; components of
   these are the classes.

Cases: null texts and texts without words are classes of their own with no link; rows without an id
have no class; rows of one id and one text are copies, those of one id and other texts are
documents of their own; short texts are compared by their
only shingle; further columns aren't read. The time for one group of texts that all share bands with
each other grows with the square of its different texts, over as many tasks; in a chain of texts
that share bands with their neighbours only it grows with the chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.components import components
from shelfspark.llm.frames import written
from shelfspark.llm.spans import FOLDED, Piece, Rolling, mix, pieces, window_starts

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
VALUES = 256
STEP = 32
TOLERANCE = 1e-7
BLOCK = 256
_COLUMNS = 4096
_AT_ONCE = 1 << 16
_random = np.random.default_rng(99)
_FACTORS = _random.integers(1, 1 << 32, (2, VALUES), np.uint32) | np.uint32(1)


def shingle_sets(piece: Piece, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    starts, ends = piece.words()
    bounds = piece.per_text(starts)
    words = Rolling(Rolling(piece.bytes, FOLDED).of(starts, ends))
    counts = np.diff(bounds)
    full = window_starts(bounds, size)
    short = bounds[:-1][(counts > 0) & (counts < size)]
    first = np.concatenate((full, short))
    last = np.concatenate((full + size, bounds[1:][(counts > 0) & (counts < size)]))
    hashes = words.of(first, last)
    owner = np.searchsorted(bounds, first, "right") - 1
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    edges = np.searchsorted(owner, np.arange(len(piece) + 1))
    return [hashes[a:b] for a, b in zip(edges, edges[1:])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, a row each."""
    found = np.empty((len(sets), VALUES), np.uint32)
    low = 0
    while low < len(sets):
        high, size = low + 1, len(sets[low])
        while high < len(sets) and size + len(sets[high]) <= _AT_ONCE:
            size += len(sets[high])
            high += 1
        values = (np.concatenate(sets[low:high]) >> np.uint64(32)).astype(np.uint32)
        begins = np.cumsum([0, *map(len, sets[low:high - 1])])
        work = np.empty_like(values)
        for k in range(VALUES):
            np.multiply(values, _FACTORS[0, k], out=work)
            np.bitwise_xor(work, work >> np.uint32(15), out=work)
            np.multiply(work, _FACTORS[1, k], out=work)
            found[low:high, k] = np.minimum.reduceat(work, begins)
        low = high
    return found


def band_keys(signed: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of every row; different bands never share keys by design."""
    keys = np.empty((len(signed), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(signed), band + 1, np.uint64)
        for value in signed[:, band * ROWS:(band + 1) * ROWS].T:
            key = mix(key ^ value.astype(np.uint64)) + np.uint64(band)
        keys[:, band] = key
    return keys.view(np.int64)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = 0, 1, .. values compared: matches below which a pair is dropped."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    logs, other = np.log(grid), np.log1p(-grid)
    above = grid >= threshold
    least = np.zeros(VALUES + 1, np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            like = m * logs + (n - m) * other
            like = np.exp(like - like.max())
            if like[above].sum() / like.sum() >= tolerance:
                break
        least[n] = m
    return least


def prune(signed: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that may still reach the threshold."""
    matches = np.zeros(len(a), np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        matches += (signed[a, n - STEP:n] == signed[b, n - STEP:n]).sum(1)
        alive = matches >= least[n]
        a, b, matches = a[alive], b[alive], matches[alive]
    return a, b


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with all sets, some thousand shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.diff(column, prepend=-1) > 0) - 1 if len(column) else column
    sizes = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        held = np.zeros((len(sets), min(_COLUMNS, int(column[b - 1]) + 1 - low)), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        sizes += np.rint(held @ held.T).astype(np.int64)
    return sizes


def candidates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that have a key in common in some band."""
    shared = np.zeros((len(keys), len(keys)), bool)
    for band in keys.T:
        shared |= band[:, None] == band[None, :]
    return np.nonzero(np.triu(shared, 1))


def linked_pairs(sets: list[np.ndarray], signed: np.ndarray, a: np.ndarray, b: np.ndarray,
                 threshold: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those whose Jaccard similarity is at least ``threshold``."""
    a, b = prune(signed, a, b, least)
    if not len(a):
        return a, b
    used, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    common = intersections([sets[k] for k in used])[index[:len(a)], index[len(a):]]
    sizes = np.array([len(s) for s in sets], np.int64)
    share = Fraction(threshold).limit_denominator(10_000)
    linked = common * share.denominator >= share.numerator * (sizes[a] + sizes[b] - common)
    return a[linked], b[linked]


def _group(total: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 .. total-1 the least node reached over the pairs."""
    root = np.arange(total)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile(table: pa.Table, threshold: float, least: np.ndarray) -> pa.Table:
    """Links, least linked node and compared pairs of a tile's nodes; rows of one node count once."""
    table = table.combine_chunks()
    nodes, groups, blocks = (table[c].to_pylist() for c in ("node", "root", "block"))
    first = {n: k for k, n in reversed(list(enumerate(nodes)))}
    order = sorted(first.values(), key=lambda k: (groups[k], nodes[k]))
    weights = table["weight"].to_numpy()[order]
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    sets = [np.frombuffer(table["shingles"][k].as_buffer(), np.uint64) for k in order]
    blocks = np.array([blocks[k] for k in order])
    groups = [groups[k] for k in order]
    signed = signatures(sets)
    keys = band_keys(signed)
    links, roots = np.zeros(len(order), np.int64), np.arange(len(order))
    compared = np.zeros(len(order), np.int64)
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and groups[high] == groups[low]:
            high += 1
        a, b = candidates(keys[low:high])
        if i != j:
            apart = blocks[low:high][a] != blocks[low:high][b]
            a, b = a[apart], b[apart]
        if len(a):
            np.add.at(compared, a + low, 1)
            a, b = linked_pairs(sets[low:high], signed[low:high], a, b, threshold, least)
            np.add.at(links, a + low, weights[b + low])
            np.add.at(links, b + low, weights[a + low])
            roots[low:high] = _group(high - low, a, b) + low
        low = high
    names = [nodes[k] for k in order]
    return pa.table({"node": pa.array(names, pa.binary()), "links": pa.array(links),
                     "least": pa.array([names[r] for r in roots], pa.binary()),
                     "compared": pa.array(compared)})


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(rows: DataFrame) -> DataFrame:
    """Per document with words: doc_id, node, bands."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                sets = shingle_sets(piece)
                filled = [k for k, s in enumerate(sets) if len(s)]
                keys = band_keys(signatures([sets[k] for k in filled]))
                nodes = [_node(sets[k]) for k in filled]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(piece)).take(pa.array(filled, pa.int64())),
                     pa.array(nodes, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    ["doc_id", "node", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, node binary, bands array<long>")


def _with_shingles(rows: DataFrame) -> DataFrame:
    """The rows with ``shingles`` in place of ``text``, which comes last after ``node``, which is first.

    Rows whose text is another one of their id go. Each task gives a node once.
    """
    last = len(rows.columns) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            for piece in pieces(batch.column(last)):
                part = batch.slice(piece.first, len(piece))
                kept, sets = [], []
                for k, (node, found) in enumerate(zip(part.column(0).to_pylist(), shingle_sets(piece))):
                    if node not in given and node == _node(found):
                        given.add(node)
                        kept.append(k)
                        sets.append(found.tobytes())
                part = part.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:last], pa.array(sets, pa.binary())],
                    [*part.schema.names[:last], "shingles"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:last])
    return rows.mapInArrow(work, f"{fields}, shingles binary")


def shared_keys(signed: DataFrame) -> DataFrame:
    """``node``, ``key`` and ``head``, the least node with that key, for keys of two nodes or more."""
    keys = written(signed.groupBy("node").agg(F.any_value("bands").alias("bands"))
                   .select("node", F.explode("bands").alias("key")), "bands")
    heads = written(keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail"))
                    .where("head <> tail").select("key", "head"), "band-heads")
    return written(keys.join(heads, "key"), "shared-bands")


def candidate_groups(shared: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the nodes that share a band with another, transitively."""
    return components(shared.where("node <> head").select("node", "head"), "node", "head")


def tiles(nodes: DataFrame, groups: DataFrame, shared: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes once for each tile they are in: t, i, j, block, root and their own columns."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    sized = written(groups.join(sizes, "root"), "groups")
    small, large = sized.where(F.col("size") <= block), sized.where(F.col("size") > block)
    packs = max(1, small.count() // block)
    pack = F.pmod(F.xxhash64("root"), F.lit(packs)).cast("int")
    together = small.select("node", "root", F.lit(b"").alias("t"), pack.alias("i"), pack.alias("j"),
                            F.lit(0).alias("block"))
    n = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = written(large.select("node", "root", "size", n.alias("n"),
                               F.pmod(F.xxhash64("node"), n).cast("int").alias("block")), "large-groups")
    placed = written(shared.select("node", "key").join(own, "node"), "large-keys")
    # What it takes to list, key by key, the blocks that a node's keys lead to. A group in which that is
    # more than all its blocks for every node is dense, and all its blocks meet.
    effort = (placed.groupBy("root", "size", "n", "key")
              .agg(F.count("*").alias("m"), F.count_distinct("block").alias("b"))
              .groupBy("root", "size", "n").agg(F.sum(F.col("m") * F.col("b")).alias("effort")))
    sparse = written(effort.where(F.col("effort") <= F.col("size") * F.col("n")).select("root"), "sparse-groups")
    thin = placed.join(sparse, "root", "left_semi")
    others = thin.select("key", F.col("block").alias("other")).distinct()
    met = thin.join(others, "key").select("node", "root", "block", "other").distinct().unionByName(
        own.join(sparse, "root", "left_anti").select(
            "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")))
    apart = met.select("node", "root", F.col("root").alias("t"), F.least("block", "other").alias("i"),
                       F.greatest("block", "other").alias("j"), "block")
    return nodes.join(written(together.unionByName(apart), "tiles"), "node").select(
        "t", "i", "j", "node", "root", "block", "weight", "shingles")


def linked(nodes: DataFrame, groups: DataFrame, shared: DataFrame, threshold: float = THRESHOLD,
           block: int = BLOCK) -> DataFrame:
    """For each node of each tile: links, the least node it is linked with, and compared pairs."""
    least = least_matches(threshold)
    return (tiles(nodes, groups, shared, block).groupBy("t", "i", "j")
            .applyInArrow(lambda table: _tile(table, threshold, least),
                          "node binary, links long, least binary, compared long"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, class_id (the least id of its class) and n_links.

    ``n_links`` counts the other documents of a similarity of at least ``threshold``, copies included.
    """
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    named = rows.where("doc_id IS NOT NULL")
    signed = written(_signed(named), "signed")
    members = signed.select("doc_id", "node")
    info = written(members.groupBy("node").agg(F.count("*").alias("weight"),
                                               F.min("doc_id").alias("least_doc")), "nodes")
    shared = shared_keys(signed)
    groups = written(candidate_groups(shared), "candidates")
    # One document of each node brings its shingles; the texts of its id are read again for that.
    wanted = info.join(groups, "node").select("node", "weight", F.col("least_doc").alias("doc_id"))
    held = written(_with_shingles(wanted.join(named, "doc_id").select("node", "weight", "doc_id", "text"))
                   .drop("doc_id"), "shingles")
    found = written(linked(held, groups, shared, threshold, block), "links")
    roots = components(found, "node", "least")
    classes = (info.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
               .join(roots, "node", "left")
               .select("node", "weight", "least_doc", F.coalesce("links", F.lit(0)).alias("links"),
                       F.coalesce("root", "node").alias("root")))
    classes = written(classes, "classes")
    named_classes = classes.groupBy("root").agg(F.min("least_doc").alias("class_id"))
    told = written(classes.join(named_classes, "root").select(
        "node", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links")), "node-classes")
    with_words = members.join(told, "node").select("doc_id", "class_id", "n_links")
    # Documents without words, which no join needs to see.
    alone = _wordless(rows).select("doc_id", F.col("doc_id").alias("class_id"),
                                   F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(alone)


def _wordless(rows: DataFrame) -> DataFrame:
    """Documents without an id or without a word; the words are those of ``Piece.words``."""
    word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return rows.where(F.col("doc_id").isNull() | ~word).select("doc_id")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that a class of lesser id stands for, in their own columns.

    Rows of one id stay or go together; rows without an id stay.
    """
    found = near_duplicates(docs, doc, text, threshold)
    gone = found.where("class_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[doc] == gone["gone_id"], "left_anti")
