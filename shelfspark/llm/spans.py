"""Words, lines and windows of whole Arrow columns as array operations on their UTF-8 bytes.

A column is cut into pieces of bounded size. In a piece every text ends with one line feed, so
neither a word nor a line runs over into the next text. Hashes are differences of running sums:
the hash of bytes s..e is (sum of value * M**i over s..e) * M**-s modulo the prime 2**31 - 1, for two
multipliers M, which costs some array operations per byte and few per word. (Modulo a power of two,
whatever M is, long strings of two letters in Thue-Morse order and their letter-swapped twins would
collide.) Equal content has an equal hash; where different content must never pass for equal,
``distinct_spans`` and ``agree`` compare every occurrence with its representative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 21
_PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(_PRIME), np.uint64(31)
_MULTIPLIERS = (0x5DEECE66, 0x2545F491)
#: Which bits of a value each of the two hashes takes.
_SHIFTS = (np.uint64(0), np.uint64(33))
_STEP = 1 << 15
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _folded(x: np.ndarray) -> np.ndarray:
    return (x & _P) + (x >> _BITS)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Below the prime, for any 64-bit value."""
    x = _folded(_folded(_folded(x)))
    return np.where(x >= _P, x - _P, x)


def _table(base: int, size: int) -> np.ndarray:
    powers = np.ones(size, np.uint64)
    done = 1
    while done < size:
        more = min(done, size - done)
        powers[done:done + more] = _reduced(powers[:more] * np.uint64(pow(base, done, _PRIME)))
        done += more
    return powers


def _powers_to(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both multipliers their powers and the powers of their inverses."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, PIECE_BYTES + 1024)
        _powers[:] = [(_table(m, size), _table(pow(m, -1, _PRIME), size)) for m in _MULTIPLIERS]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit values, up to 2**32 of them.

    With a ``table`` the sequence holds places in it, and the values are those found there.
    """

    def __init__(self, values: np.ndarray, table: np.ndarray | None = None) -> None:
        self.sums = []
        for (ups, _), shift in zip(_powers_to(len(values) + 1), _SHIFTS):
            sums = np.zeros(len(values) + 1, np.uint64)
            own = None if table is None else (table >> shift) & _P
            # Some thousand terms at a time, in arrays that stay in the cache; each is below 2**32.
            terms, rest = np.empty(_STEP, np.uint64), np.empty(_STEP, np.uint64)
            for low in range(0, len(values), _STEP):
                part = values[low:low + _STEP]
                n = len(part)
                t, r = terms[:n], rest[:n]
                if own is None:
                    np.right_shift(part, shift, out=t)
                    np.bitwise_and(t, _P, out=t)
                else:
                    np.take(own, part, mode="clip", out=t)
                np.multiply(t, ups[low:low + n], out=t)
                np.right_shift(t, _BITS, out=r)
                np.bitwise_and(t, _P, out=t)
                np.add(t, r, out=sums[low + 1:low + 1 + n])
            np.cumsum(sums, out=sums)
            self.sums.append(sums)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        parts = [_reduced(_reduced(sums[ends] - sums[starts]) * downs[starts])
                 for sums, (_, downs) in zip(self.sums, _powers)]
        return mix((parts[0] << np.uint64(32)) | parts[1])


def agree(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other_starts: np.ndarray,
          other_ends: np.ndarray) -> np.ndarray:
    """Whether each stretch has the same content as the other one beside it."""
    sizes = ends - starts
    same = sizes == other_ends - other_starts
    todo = np.flatnonzero(same & (starts != other_starts) & (sizes > 0))
    low = 0
    while low < len(todo):
        # About a million elements at a time.
        part = todo[low:low + 200_000]
        total = np.cumsum(sizes[part])
        part = part[:max(1, int(np.searchsorted(total, 1 << 20)))]
        size = sizes[part]
        begins = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        a = data[step + np.repeat(starts[part] - begins, size)]
        b = data[step + np.repeat(other_starts[part] - begins, size)]
        same[part] = ~np.logical_or.reduceat(a != b, begins)
        low += len(part)
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray
                   ) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch the number of its content, and a stretch for each of these numbers.

    Stretches that share a hash with other content get numbers of their own.
    """
    coded = pa.array(hashes).dictionary_encode()
    codes = coded.indices.to_numpy().copy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    apart = np.flatnonzero(~agree(data, starts, ends, starts[first][codes], ends[first][codes]))
    more: dict[bytes, int] = {}
    extra = []
    for i in apart.tolist():
        content = data[starts[i]:ends[i]].tobytes()
        if content not in more:
            more[content] = len(first) + len(extra)
            extra.append(i)
        codes[i] = more[content]
    return codes, np.concatenate((first, np.array(extra, np.int64)))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low:high + 1] = True
    return found


#: Values of bytes with A-Z as a-z.
FOLDED = _byte_values()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Digits, letters and every byte of a code point above 0x7F.
WORD_BYTES = _byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SPACE_BYTES = _byte_set((0x20, 0x20), (0x09, 0x0D))


class Piece:
    """Texts ``first`` to ``last`` of a batch: their bytes, each text closed by a line feed."""

    def __init__(self, first: int, last: int, texts: pa.Array) -> None:
        self.first, self.last = first, last
        closed = pc.binary_join_element_wise(texts, pa.scalar("", texts.type),
                                             pa.scalar("\n", texts.type))
        _, offsets, data = closed.buffers()
        kind = np.int64 if pa.types.is_large_string(closed.type) else np.int32
        edges = np.frombuffer(offsets, kind)[closed.offset:closed.offset + len(closed) + 1]
        self.bytes = np.frombuffer(data, np.uint8)[int(edges[0]):int(edges[-1])]
        #: Where each text begins; one more for the end.
        self.edges = (edges - edges[0]).astype(np.int64)

    def __len__(self) -> int:
        return self.last - self.first

    def per_text(self, starts: np.ndarray) -> np.ndarray:
        """Index of the first span of each text, one more for the end; spans are in order."""
        return np.searchsorted(starts, self.edges)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of all texts."""
        return runs(WORD_BYTES[self.bytes])


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    padded = np.zeros(len(inside) + 2, np.int8)
    padded[1:-1] = inside
    edges = np.flatnonzero(np.diff(padded))
    return edges[::2], edges[1::2]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """A column in pieces of about ``limit`` bytes, one text at least; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(texts):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield Piece(first, last, texts.slice(first, last - first))
        first = last


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Indices i of spans such that i .. i+size-1 lie in one text; ``bounds`` as per_text gives."""
    room = np.repeat(bounds[1:], np.diff(bounds))
    index = np.arange(bounds[0], bounds[-1])
    return index[index + size <= room]
