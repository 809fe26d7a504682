"""BPE encoding and decoding of whole columns: speculate, verify, and merge what fails.

Words are split as the tokenizer file says (composed characters, lower case, white space dropped).
Each distinct word of a piece gets the greedy longest-match proposal; one array check over all
adjacent pairs of all proposals decides which stand, and only the words with an incompatible pair
are merged exactly. Decoding joins the tokens' own strings with one space, which is what a file
without a decoder asks for.

Cases: a null text is encoded as an empty one and has no ids; special strings inside a text give
their own id; repeated rows are encoded alike; texts of any length; further columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.bpe import Memo, Vocabulary, WordIds
from shelfspark.llm.spans import pieces


def ids_of_pieces(batches: Iterator[pa.RecordBatch], at: int, vocabulary: Vocabulary | None = None,
                  words: WordIds | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Per piece: its rows, all ids, and where each text's ids begin (one more for the end). The words'
    ids come from ``words`` where given, else from the vocabulary."""
    words = words or WordIds(vocabulary.special, vocabulary.encode_words)
    for batch in batches:
        for piece in pieces(batch.column(at)):
            yield batch.slice(piece.first, len(piece)), *words(piece)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with the column ``ids``: array of int."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, bounds in ids_of_pieces(batches, at, shared.value):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids])

    return docs.mapInArrow(work, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the column ``text``: the tokens of ``ids`` joined by one space."""
    vocabulary = Vocabulary(path)
    names = [vocabulary.names.get(i) for i in range(vocabulary.size)]
    shared = frame.sparkSession.sparkContext.broadcast(names)
    at = frame.columns.index(ids)
    schema = T.StructType([*frame.schema.fields, T.StructField(text, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else " ".join([shared.value[i] for i in x])
                     for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*batch.schema.names, text])

    return frame.mapInArrow(work, schema)


def code_report(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens and the digests of its ids and of the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.names
        memo = Memo(shared.value, lambda ids: (
            len(ids), " ".join(map(str, ids)).encode(), " ".join([names[i] for i in ids]).encode()))
        for batch in batches:
            for piece in pieces(batch.column(1)):
                codes, found, bounds = memo(piece)
                sizes, digits, strings = zip(*found) if found else ((), (), ())
                total = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)[codes])))[bounds]
                codes, bounds = codes.tolist(), bounds.tolist()
                spans = list(zip(bounds, bounds[1:]))
                digests = [[hashlib.sha256(b" ".join([parts[c] for c in codes[a:b]])).hexdigest()
                            for a, b in spans] for parts in (digits, strings)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(piece)),
                     pa.array(np.diff(total), pa.int64()), *map(pa.array, digests)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
