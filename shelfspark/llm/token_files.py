"""Token ids of a corpus as range-coded files, written in ascending id order and read back.

A file is Parquet; a row is a block: ``shard`` and ``block`` (its place), ``first`` (ids of the
shard before the block's first document), ``docs`` (id and number of ids of each of its documents),
``part`` of ``parts`` (a document of more than ``BLOCK_IDS`` ids fills several blocks, all others lie
in one), ``n_ids``, ``crc`` (checksum of the ids) and ``payload`` (see ``id_coder``). Each block is
decoded without any other; a checksum that differs stops the job. Shards are the partitions of
a range partitioning, so their order is the order of the ids.

Cases: null and empty texts have the end id only; rows without an id come first; rows of one id
follow one another, ordered by their texts, and may spread over shards; no documents give no file
with rows; ids must be below 65,536, else writing stops.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.llm.bpe import WordIds, byte_characters, special_strings
from shelfspark.llm.encode import ids_of_pieces
from shelfspark.llm.frames import written
from shelfspark.llm.id_coder import BLOCK_IDS, LANES, checksum, decode_blocks, encode_blocks
from shelfspark.session import scratch_path

END_ID = 1


@lru_cache(2)
def library_words(told: str) -> WordIds:
    """Ids as the tokenizers library gives them to single words, for a tokenizer file of this content.
    Kept by the worker, so that a word is encoded once for all its tasks."""
    model = Tokenizer.from_str(told).model
    characters = str.maketrans(dict(enumerate(byte_characters())))

    def encode(words: list[bytes]) -> Iterator[list[int]]:
        for word in words:
            letters = word.decode("latin-1")
            # Visible ASCII characters stand for themselves.
            if not (letters.isascii() and letters.isprintable()):
                letters = letters.translate(characters)
            yield [t.id for t in model.tokenize(letters)]

    return WordIds(special_strings(json.loads(told)), encode)


def _blocks(documents: Iterator[tuple[object, np.ndarray]]) -> Iterator[dict]:
    """Documents (id, ids) packed into blocks without payload."""
    held: list[tuple[object, np.ndarray]] = []
    size = begun = first = 0

    def packed() -> dict:
        return {"first": first, "docs": [{"doc_id": d, "n_ids": len(x)} for d, x in held],
                "part": 0, "parts": 1, "ids": np.concatenate([x for _, x in held])}

    for doc, ids in documents:
        if held and size + len(ids) > BLOCK_IDS:
            yield packed()
            held, size, first = [], 0, begun
        if len(ids) > BLOCK_IDS:
            parts = -(-len(ids) // BLOCK_IDS)
            for k in range(parts):
                yield {"first": begun, "docs": [{"doc_id": doc, "n_ids": len(ids)}], "part": k,
                       "parts": parts, "ids": ids[k * BLOCK_IDS:(k + 1) * BLOCK_IDS]}
            begun += len(ids)
            first = begun
            continue
        held.append((doc, ids))
        size += len(ids)
        begun += len(ids)
    if held:
        yield packed()


def write_ids(docs: DataFrame, tokenizer: str, path: str, doc: str = "doc_id", text: str = "text",
              end_id: int = END_ID) -> None:
    """Encode all texts, append ``end_id`` to each, and write the files to a shared path."""
    with open(tokenizer, encoding="utf-8") as file:
        told = file.read()
    content = json.loads(told)
    if max(*content["model"]["vocab"].values(), *special_strings(content).values()) >= 1 << 16:
        raise ValueError("the coder takes ids below 65,536")
    shared = docs.sparkSession.sparkContext.broadcast(told)
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The text's hash splits an id that very many rows have.
    ordered = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"shard int, block int, first long, part int, parts int, n_ids int, crc long, "
              f"docs array<struct<doc_id: {kind}, n_ids: int>>, payload binary")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
        for part, ids, bounds in ids_of_pieces(batches, 1, words=library_words(shared.value)):
            ended = np.insert(ids.astype(np.uint16), bounds[1:], end_id)
            edges = (bounds + np.arange(len(bounds))).tolist()
            for name, a, b in zip(part.column(0).to_pylist(), edges, edges[1:]):
                yield name, ended[a:b]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done = TaskContext.get().partitionId(), 0
        waiting: list[dict] = []
        kinds = None

        def coded() -> pa.RecordBatch:
            payloads = encode_blocks([b["ids"] for b in waiting])
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": done + k, "first": b["first"], "part": b["part"],
                  "parts": b["parts"], "n_ids": len(b["ids"]), "crc": checksum(b["ids"]),
                  "docs": b["docs"], "payload": p} for k, (b, p) in enumerate(zip(waiting, payloads))],
                kinds)

        def typed(source):
            nonlocal kinds
            for batch in source:
                kinds = pa.schema([
                    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()),
                    ("part", pa.int32()), ("parts", pa.int32()), ("n_ids", pa.int32()),
                    ("crc", pa.int64()), ("docs", pa.list_(pa.struct([
                        ("doc_id", batch.schema.field(0).type), ("n_ids", pa.int32())]))),
                    ("payload", pa.binary())])
                yield batch

        for block in _blocks(documents(typed(batches))):
            waiting.append(block)
            if len(waiting) == LANES:
                yield coded()
                done, waiting = done + len(waiting), []
        if waiting:
            yield coded()

    ordered.mapInArrow(work, schema).write.parquet(path)


def _decoded(blocks: DataFrame, keep: bool) -> DataFrame:
    """Per document of a block: shard, at, doc_id, n_tokens, part, parts, crc, and its ids as bytes
    where ``keep`` asks for them or the document goes on in other blocks."""
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, LANES):
                rows = batch.slice(low, LANES)
                told = rows.select(["shard", "first", "part", "parts", "n_ids", "crc", "docs"]).to_pylist()
                payloads = [p.as_py() for p in rows["payload"]]
                out: list[tuple] = []
                for row, ids in zip(told, decode_blocks(payloads, [r["n_ids"] for r in told])):
                    if checksum(ids) != row["crc"]:
                        raise ValueError(f"damaged block at {row['first']} of shard {row['shard']}")
                    raw = ids.astype("<u4").tobytes()
                    whole, at = row["parts"] == 1, 0
                    for d in row["docs"]:
                        mine = raw[4 * at:4 * (at + d["n_ids"])] if whole else raw
                        out.append((row["shard"], row["first"] + at, d["doc_id"], d["n_ids"], row["part"],
                                    row["parts"], zlib.crc32(mine), mine if keep or not whole else None))
                        at += d["n_ids"]
                columns = list(zip(*out)) or [()] * 8
                kinds = [pa.int32(), pa.int64(), batch.schema.field("docs").type.value_type.field(0).type,
                         pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["shard", "at", "doc_id", "n_tokens", "part", "parts", "crc", "ids"])

    return blocks.select("shard", "first", "part", "parts", "n_ids", "crc", "docs", "payload").mapInArrow(
        work, f"shard int, at long, doc_id {kind}, n_tokens long, part int, parts int, crc long, ids binary")


def _joined(found: DataFrame) -> DataFrame:
    """The documents of several blocks, their ids put together; one document is one group."""
    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("part")
        whole = b"".join(p.as_py() for p in table["ids"])
        first = table.slice(0, 1)
        first = first.set_column(6, "crc", pa.array([zlib.crc32(whole)], pa.int64()))
        return first.set_column(7, "ids", pa.array([whole], pa.binary()))

    return found.groupBy("shard", "at").applyInArrow(work, found.schema)


def read_ids(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 and, with ``keep``, ids as
    little-endian unsigned 32-bit integers."""
    blocks = spark.read.parquet(path)
    # All blocks in one pass, many side by side; documents of several blocks are put together after.
    found = written(_decoded(blocks, keep), "decoded-ids")
    whole = found.where("parts = 1").unionByName(_joined(found.where("parts > 1")))
    # As many rows as there are shards.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
               .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    out = whole.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens",
        F.col("crc").alias("ids_crc32"), "ids")
    return out if keep else out.drop("ids")


def file_report(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text",
                end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder, and what reading them back gives per document."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_ids(docs, tokenizer, path, doc, text, end_id)
    return read_ids(docs.sparkSession, path, keep=False)
