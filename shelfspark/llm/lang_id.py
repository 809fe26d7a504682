"""Language identification by rank-order profiles of letter n-grams.

A text is lower-cased; its words are the runs of Unicode letters, each with a blank on either side,
and its n-grams are the one to three characters long ones inside such a word. A profile is a list of the
``TOP`` most frequent n-grams, ties in code point order. A language's profile counts over all of
its training texts. The distance of a text to a language adds, for each n-gram of the text's own
profile, how far its two ranks are apart, or TOP where the language lacks it; the nearest language
wins, the alphabetically first among equals. The score is one minus that distance over the largest
possible one.

Cases: null texts and texts without a letter are ``und`` with score 0; rows without an id are held
out; a training table without languages makes every text ``und``; repeated rows each count; texts
of any length are read whole; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.bpe import LETTER, class_table
from shelfspark.llm.frames import free_name
from shelfspark.llm.spans import Piece, pieces

TOP = 300
UNKNOWN = "und"
#: Profiles are collected and broadcast: TOP rows a language.
MAX_LANGUAGES = 2000
#: Standard deviations below the mean score of a language's texts at which a text is not in it, and
#: the texts that such a spread is taken from at least.
SPREADS = 5
LEAST_TEXTS = 30
_POINT_BITS = 21
#: Distinct n-grams a task gathers before it hands its counts on.
_GATHER = 1 << 20


def _letters(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, runs of anything but letters as one 0, with the text of each."""
    raw, edges = piece.bytes.tobytes(), piece.edges.tolist()
    texts = [raw[a:b - 1].decode().lower() for a, b in zip(edges, edges[1:])]
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    letter = class_table()[points] == LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.concatenate(([0], owner))
    return np.where(letter, points, 0)[keep].astype(np.int64), owner[keep]


def _grams(points: np.ndarray, owner: np.ndarray, bits: int) -> np.ndarray:
    """Every n-gram as owner and three characters of ``bits`` bits each, in one number."""
    letter = points > 0
    one = points[letter]
    a, b = points[:-1], points[1:]
    pair = letter[:-1] | letter[1:]
    two = ((a << bits) | b)[pair]
    x, y, z = points[:-2], points[1:-1], points[2:]
    middle = letter[1:-1]
    three = ((x << 2 * bits) | (y << bits) | z)[middle]
    # Sizes are told apart by a leading marker character, one above the alphabet's largest.
    mark = (1 << bits) - 1
    one = one | (mark << bits) | (mark << 2 * bits)
    two = two | (mark << 2 * bits)
    whose = (owner[letter], np.where(letter[1:], owner[1:], owner[:-1])[pair], owner[1:-1][middle])
    return np.concatenate([(w << 3 * bits) | g for w, g in zip(whose, (one, two, three))])


def _counted(points: np.ndarray, owner: np.ndarray, owners: int
             ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (owner, n-gram, count), ascending; n-grams as three code points of 21 bits."""
    alphabet = np.unique(points)
    if alphabet[0] != 0:
        alphabet = np.concatenate(([0], alphabet))
    bits = int(len(alphabet)).bit_length()
    at_once = 1 << max(0, 63 - 3 * bits)
    wide = np.concatenate((alphabet, np.full((1 << bits) - len(alphabet), (1 << _POINT_BITS) - 1)))
    small = np.searchsorted(alphabet, points)
    mask = (1 << bits) - 1
    for low in range(0, owners, at_once):
        mine = slice(None)
        if owners > at_once:
            begin, end = np.searchsorted(owner, [low, low + at_once])
            mine = slice(max(0, begin - 1), end)
        keys, counts = np.unique(_grams(small[mine], np.maximum(owner[mine] - low, 0), bits),
                                 return_counts=True)
        grams = ((wide[(keys >> 2 * bits) & mask] << 2 * _POINT_BITS)
                 | (wide[(keys >> bits) & mask] << _POINT_BITS) | wide[keys & mask])
        yield (keys >> 3 * bits) + low, grams, counts


def profiles(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP) -> DataFrame:
    """The languages' profiles: ``lang``, ``gram``, ``place`` (0 is the most frequent)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def settle(parts):
            grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            for name, parts in gathered.items():
                grams, counts = settle(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                    ["lang", "gram", "n"])

        for batch in batches:
            for piece in pieces(batch.column(1)):
                coded = batch.column(0).slice(piece.first, len(piece)).dictionary_encode()
                names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                points, owner = _letters(piece)
                if not points.any():
                    continue
                # By language; texts stay apart by their blanks, the first has one before it.
                order = np.argsort(index[owner], kind="stable")
                mine = index[owner][order]
                for whose, grams, counts in _counted(np.append(0, points[order]), np.append(mine[0], mine),
                                                     len(names)):
                    for k in np.unique(whose).tolist():
                        parts = gathered.setdefault(names[k], [])
                        parts.append((grams[whose == k], counts[whose == k]))
                        held += len(parts[-1][0])
                if held > _GATHER:
                    gathered = {n: [settle(p)] for n, p in gathered.items()}
                    held = sum(len(p[0][0]) for p in gathered.values())
                    if held > _GATHER // 2:
                        yield from told()
                        gathered, held = {}, 0
        yield from told()

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    counted = (docs.where(F.col(lang).isNotNull()).select(lang, text)
               .mapInArrow(count, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # Compared as it is, so that Spark keeps the first rows of a language before it shuffles.
    first = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return first.select("lang", "gram", (F.col("place") - 1).alias("place"))


class Profiles:
    """All profiles side by side: places[k, j] is the place of gram k in language j, or top."""

    def __init__(self, rows: list, top: int = TOP) -> None:
        self.top = top
        self.langs = sorted({r["lang"] for r in rows})
        if len(self.langs) > MAX_LANGUAGES:
            raise ValueError(f"{len(self.langs)} languages, more than {MAX_LANGUAGES}")
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.langs)), top, np.int32)
        at = np.searchsorted(self.grams, [r["gram"] for r in rows])
        which = [self.langs.index(r["lang"]) for r in rows]
        self.places[at, which] = [r["place"] for r in rows]

    def predict(self, piece: Piece) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = [UNKNOWN] * len(piece), np.zeros(len(piece))
        points, owner = _letters(piece)
        if not self.langs or not points.any():
            return names, scores
        for whose, grams, counts in _counted(points, owner, len(piece)):
            # n-grams ascend within a text already, so a stable sort leaves ties in their order.
            most = int(counts.max())
            order = np.argsort(whose * (most + 1) + (most - counts), kind="stable")
            whose, grams = whose[order], grams[order]
            first = np.flatnonzero(np.diff(whose, prepend=-1))
            place = np.arange(len(whose)) - np.repeat(first, np.diff(np.append(first, len(whose))))
            kept = place < self.top
            whose, grams, place = whose[kept], grams[kept], place[kept]
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            at = np.where(self.grams[at] == grams, at, len(self.grams))
            theirs = self.places[at]
            apart = np.where(theirs < self.top, np.abs(theirs - place[:, None]), self.top)
            first = np.flatnonzero(np.diff(whose, prepend=-1))
            sums = np.add.reduceat(apart, first, axis=0)
            sizes = np.diff(np.append(first, len(whose)))
            best = np.argmin(sums, axis=1)
            for k, j in zip(whose[first].tolist(), best.tolist()):
                names[k] = self.langs[j]
            scores[whose[first]] = 1 - sums[np.arange(len(best)), best] / (sizes * self.top)
        return names, scores


def held_out(doc: str, folds: int = 5) -> F.Column:
    """Whether a row is never learned from; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % folds == 0, F.lit(True))


def predict(docs: DataFrame, learned: DataFrame, text: str = "text", lang_pred: str = "lang_pred",
            score: str = "score", top: int = TOP) -> DataFrame:
    """The documents with the two columns; ``learned`` as ``profiles`` returns it."""
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(learned.collect(), top))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()),
                           T.StructField(score, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(at)):
                names, scores = shared.value.predict(piece)
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores)],
                    [*part.schema.names, lang_pred, score])

    return docs.mapInArrow(work, schema)


def language_report(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                    lang: str = "lang") -> DataFrame:
    """Per document: held_out, lang_pred, score; learned from the rows that aren't held out."""
    learned = profiles(docs.where(~held_out(doc)), lang, text)
    rows = docs.select(F.col(doc).alias("doc_id"), held_out(doc).alias("held_out"),
                       F.col(text).alias("text"))
    return predict(rows, learned).drop("text")


def least_scores(found: DataFrame, lang_pred: str, score: str, lang: str, limit: str) -> DataFrame:
    """Per learned language the least score of a text in it: ``SPREADS`` standard deviations below the
    mean of all training texts whose nearest language is their own; ``found`` holds those texts.

    A language with fewer than ``LEAST_TEXTS`` of them has none.
    """
    own = F.col(score)
    return (found.where(F.col(lang_pred) == F.col(lang)).groupBy(F.col(lang).alias(lang_pred))
            .agg(F.when(F.count("*") >= LEAST_TEXTS, F.avg(own) - SPREADS * F.stddev_pop(own)).alias(limit)))


def keep_known(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang",
               least: float = 0.0) -> DataFrame:
    """The documents in a known language, in their own columns.

    Their score is above 0, so that they share an n-gram with the language, not below the least
    score of the language's training texts (see ``least_scores``), and ``least`` or more.
    """
    name, score, limit = (free_name(docs, n) for n in ("nearest", "score", "limit"))
    taught = docs.where(~held_out(doc))
    learned = profiles(taught, lang, text)
    limits = least_scores(predict(taught, learned, text, name, score), name, score, lang, limit)
    found = predict(docs, learned, text, name, score)
    enough = (F.col(score) > 0) & (F.col(score) >= F.greatest(F.coalesce(limit, F.lit(0.0)), F.lit(least)))
    return (found.where(F.col(name) != UNKNOWN).join(F.broadcast(limits), name, "left").where(enough)
            .drop(name, score, limit))
