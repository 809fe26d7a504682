"""Token counts by prefix dynamic programming.

For a word, ``last[i]`` is the last token of the encoding of its first i bytes and ``count[i]`` the
number of its tokens. Among the tokens that end at byte i exactly one is compatible with the last
token of what precedes it, so one pass over the word gives the exact count at every prefix, and the
word's closing token is found the same way. A text's table adds up its words: the tokens of any
prefix of whole words are one entry, a budget is one binary search, and neither encodes again.

Cases: null and empty texts count 0; special strings inside a text count one; any length of text;
repeated rows are counted alike; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.bpe import MEMO_WORDS, Memo, Vocabulary
from shelfspark.llm.spans import pieces

LIMIT = 2048


class Endings:
    """The tokens by their last bytes: nodes of a tree read from a token's end, as arrays."""

    def __init__(self, tokens: dict[bytes, int]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for letters, token in tokens.items():
            node = 0
            for byte in reversed(letters):
                node = nodes.setdefault((node, byte), len(nodes) + 1)
            ends[node] = token
        keys = np.array([n * 256 + b for n, b in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(nodes.values()), np.int64)[order]
        #: The first step goes by the byte alone.
        self.roots = np.array([nodes.get((0, b), -1) for b in range(256)], np.int64)
        self.token = np.full(len(nodes) + 1, -1, np.int64)
        self.token[list(ends)] = list(ends.values())

    def before(self, data: np.ndarray, at: np.ndarray, room: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens that end at the places ``at`` and have at most ``room`` bytes: index into
        ``at``, bytes, token. A place is left as soon as no token goes on."""
        index = np.flatnonzero(room > 0)
        node = self.roots[data[at[index] - 1]]
        found = []
        size = 1
        while True:
            index, node = index[node >= 0], node[node >= 0]
            if not len(index):
                break
            token = self.token[node]
            there = token >= 0
            found.append((index[there], np.full(int(there.sum()), size), token[there]))
            size += 1
            more = room[index] >= size
            index, node = index[more], node[more]
            keys = node * 256 + data[at[index] - size]
            places = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            node = np.where(self.keys[places] == keys, self.next[places], -1)
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


#: Words that are counted together, and from how many bytes on a word goes alone.
TOGETHER, LONG = 20_000, 512


class PrefixCounter:
    """Counts at every prefix of a word."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.inner, self.final = Endings(vocabulary.inner), Endings(vocabulary.final)

    def table(self, word: bytes, closed: bool = True) -> list[int]:
        """Tokens of the word's first 0, 1, ... bytes as part of a word; with ``closed`` the last
        entry is the whole word with its end."""
        return self.tables([word], closed)[0]

    def tables(self, words: list[bytes], closed: bool = True) -> list[list[int]]:
        counts, bounds = self._counted(words, closed)
        return [counts[a:b].tolist() for a, b in zip(bounds, bounds[1:])]

    def wholes(self, words: list[bytes]) -> list[int]:
        """The last entry of every word's table."""
        out: list[int] = []
        for k in range(0, len(words), TOGETHER):
            counts, bounds = self._counted(words[k:k + TOGETHER], True)
            out += counts[bounds[1:] - 1].tolist()
        return out

    def _counted(self, words: list[bytes], closed: bool) -> tuple[np.ndarray, np.ndarray]:
        """The tables of all words one after the other, and where each begins."""
        # Word k has the places bounds[k] .. bounds[k+1]-1, one before its first byte.
        sizes = np.array([len(w) for w in words], np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        data = np.frombuffer(b"".join([b"\0" + w for w in words]), np.uint8)
        place = np.arange(len(data)) - np.repeat(bounds[:-1], sizes + 1)
        last_place = np.zeros(len(data), bool)
        last_place[bounds[1:] - 1] = closed
        ends, starts, tokens = [], [], []
        for known, wanted in ((self.inner, ~last_place), (self.final, last_place)):
            at = np.flatnonzero(wanted & (place > 0))
            index, size, token = known.before(data, at + 1, place[at])
            ends.append(at[index])
            starts.append(at[index] - size)
            tokens.append(token)
        end, start, token = (np.concatenate(x) for x in (ends, starts, tokens))
        # A prefix that is one token is that token; nothing else is compatible then.
        whole = np.zeros(len(data), bool)
        whole[end[place[start] == 0]] = True
        kept = ~whole[end] | (place[start] == 0)
        end, start, token = end[kept], start[kept], token[kept]
        order = np.argsort(place[end], kind="stable")
        end, start, token = end[order], start[order], token[order]
        last, count = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        steps = np.searchsorted(place[end], np.arange(1, LONG + 2))
        for a, b in zip(steps, steps[1:]):
            if a < b:
                self._step(end[a:b], start[a:b], token[a:b], place, last, count)
        if steps[-1] < len(end):
            self._long(end[steps[-1]:], start[steps[-1]:], token[steps[-1]:], last, count)
        return count, bounds

    def _step(self, end, start, token, place, last, count) -> None:
        """One byte position of all words: which token closes each prefix."""
        first = place[start] == 0
        pairs, back = np.unique(np.where(first, -1, last[start] * self.v.size + token),
                                return_inverse=True)
        fits = np.ones(len(pairs), bool)
        real = pairs >= 0
        fits[real] = self.v.compatible(pairs[real] // self.v.size, pairs[real] % self.v.size)
        taken = fits[back]
        last[end[taken]] = token[taken]
        count[end[taken]] = count[start[taken]] + 1

    def _long(self, end, start, token, last, count) -> None:
        """What lies beyond the first ``LONG`` bytes of words, pair by pair."""
        known: dict[tuple[int, int], bool] = {}
        for e, s, t in zip(end.tolist(), start.tolist(), token.tolist()):
            pair = (int(last[s]), t)
            if pair not in known:
                if len(known) > MEMO_WORDS:
                    known.clear()
                known[pair] = self.v.stays_apart(*pair)
            if known[pair]:
                last[e], count[e] = t, count[s] + 1


def _totals(memo: Memo, piece) -> tuple[np.ndarray, np.ndarray]:
    """Tokens up to the end of each word of the piece (0 first), and the words before each text."""
    codes, found, bounds = memo(piece)
    sizes = np.array(found, np.int64)
    return np.concatenate(([0], np.cumsum(sizes[codes]))), bounds


def _memo(vocabulary: Vocabulary) -> Memo:
    counter = PrefixCounter(vocabulary)
    return Memo(vocabulary, lambda found: found, counter.wholes, lambda _: 1)


def with_prefix_counts(docs: DataFrame, path: str, text: str = "text",
                       table: str = "prefix_tokens") -> DataFrame:
    """The documents with ``table``: tokens of the first 0, 1, ... words (array of int)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(table, T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(shared.value)
        for batch in batches:
            for piece in pieces(batch.column(at)):
                total, bounds = _totals(memo, piece)
                lists = [total[a:b + 1] - total[a] for a, b in zip(bounds, bounds[1:])]
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lists, pa.list_(pa.int32()))],
                    [*part.schema.names, table])

    return docs.mapInArrow(work, schema)


def words_within(table: str, limit: int) -> F.Column:
    """The most words from the start of a text whose tokens stay within ``limit``."""
    return F.size(F.filter(table, lambda n: n <= F.lit(limit))) - 1


def count_report(docs: DataFrame, path: str, limit: int = LIMIT, doc: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Per document: n_bytes, n_tokens, over_limit; and the longest prefix of whole words within
    the limit, as fit_words and fit_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(shared.value)
        for batch in batches:
            for piece in pieces(batch.column(1)):
                total, bounds = _totals(memo, piece)
                before = total[bounds]
                tokens = np.diff(before)
                fit = np.searchsorted(total, before[:-1] + limit, "right") - 1
                fit = np.minimum(fit, bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(piece)),
                     pa.array(np.diff(piece.edges) - 1, pa.int64()), pa.array(tokens, pa.int64()),
                     pa.array(tokens > limit), pa.array(fit - bounds[:-1], pa.int64()),
                     pa.array(total[fit] - before[:-1], pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_words", "fit_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, "
                                 "fit_words long, fit_tokens long")
