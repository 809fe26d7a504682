"""An adaptive context-mixing range coder for blocks of token ids, in whole numbers only.

Two tables hold the id that last followed the two ids before (order 2) and the one id before
(order 1), each with a confidence. Whether the order-2 prediction holds is given a probability mixed
from the counters of both confidences in the logistic domain, by weights that learn from each outcome.
If it fails, the order-1 prediction is tried with a counter of its own; if that fails too, the id is
coded by the order-0 model, the counts of such ids in the block, which stand before its words. These
parts share one interval, so an id is one step of the range coder. Encoder and decoder run the same model.

A block is cut into lanes of ``LANE_IDS`` ids that learn apart. The lanes of all blocks of a batch
advance together, one id of each at a time, so each array operation serves hundreds or thousands of ids;
every block can be decoded alone. The range has 63 bits and gives off words of 32; carries are resolved
when a lane ends.
"""

from __future__ import annotations

import struct
import zlib
from decimal import Decimal, localcontext

import numpy as np

#: Ids in a block and in a lane; blocks coded at once.
BLOCK_IDS = 1 << 14
LANE_IDS = 1 << 10
LANES = 256
_SLOTS = (1 << 9, 1 << 9)
#: The interval of an id is a part of 2**30; some is always left for order 0, 2**15 at least.
_WHOLE = 1 << 30
_MOST2 = 4080
#: Where the counters of order 1 alone go to, of 2**16.
_NEVER, _ALWAYS = 1_024, 65_024
_FULL = np.uint64((1 << 63) - 1)
_LOW = np.uint64((1 << 31) - 1)
_SHORT = np.uint64(1 << 31)
_1, _30, _31, _32 = (np.uint64(x) for x in (1, 30, 31, 32))


def _curves() -> tuple[np.ndarray, np.ndarray]:
    """Logit of a 12-bit probability and its inverse, both in steps of 1/256.

    Decimal arithmetic is correctly rounded, so the tables are the same on every machine.
    """
    with localcontext(prec=20):
        odds = [(Decimal(2 * k + 1) / (8191 - 2 * k)).ln() * 256 for k in range(4096)]
        inverse = [4096 / (1 + (Decimal(-k) / 256).exp()) for k in range(-2048, 2048)]
    stretch = np.array([min(2047, max(-2047, round(x))) for x in odds], np.int32)
    squash = np.array([min(_MOST2, max(1, round(x))) for x in inverse], np.int32)
    return stretch, squash


_STRETCH, _SQUASH = _curves()


class Encoder:
    """Ranges of many lanes, and the words that they have given off."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _FULL)
        self.words = np.zeros((lanes, 256), np.uint64)
        self.used = np.zeros(lanes, np.int64)

    def room(self, words: int) -> None:
        if int(self.used.max()) + words >= self.words.shape[1]:
            self.words = np.pad(self.words, ((0, 0), (0, 64 + words)))

    def part(self, n: int, first: np.ndarray, share: np.ndarray) -> None:
        """Narrow the first ``n`` ranges to these parts of 2**30."""
        unit = self.range[:n] >> _30
        low, wide = self.low[:n], unit * share
        low += unit * first
        lanes = np.flatnonzero(wide < _SHORT)
        if len(lanes):
            given = low[lanes]
            self.words[lanes, self.used[lanes]] = given >> _31
            self.used[lanes] += 1
            low[lanes] = (given & _LOW) << _32
            wide[lanes] <<= _32
        self.range[:n] = wide

    def finish(self) -> list[np.ndarray]:
        self.room(2)
        every = np.arange(len(self.low))
        for _ in range(2):
            self.words[every, self.used] = self.low >> _31
            self.used += 1
            self.low = (self.low & _LOW) << _32
        while True:
            rows, columns = np.nonzero(self.words >> _32)
            if not len(rows):
                break
            self.words[rows, columns] &= np.uint64(0xFFFFFFFF)
            self.words[rows, columns - 1] += _1
        words = self.words.astype("<u4")
        return [row[:n] for row, n in zip(words, self.used.tolist())]


class Decoder:
    """The same ranges, reading words."""

    def __init__(self, lanes: list[np.ndarray]) -> None:
        words = np.zeros((len(lanes), max(map(len, lanes)) + 2), np.uint64)
        for k, found in enumerate(lanes):
            words[k, :len(found)] = found
        # The range is a bit shorter than two words: each word is read with the last bit before it.
        self.words = words >> _1
        self.words[:, 1:] |= (words[:, :-1] & _1) << _31
        self.range = np.full(len(lanes), _FULL)
        self.code = (words[:, 0] << _31) | (words[:, 1] >> _1)
        self.used = np.full(len(lanes), 2)

    def room(self, words: int) -> None:
        """Damaged input may ask for more words than there are; those read as zero."""
        if int(self.used.max()) + words >= self.words.shape[1]:
            self.words = np.pad(self.words, ((0, 0), (0, 512 + words)))

    def place(self, n: int) -> np.ndarray:
        """Where in 2**30 each of the first ``n`` codes lies."""
        self.unit = self.range[:n] >> _30
        return np.minimum((self.code[:n] // self.unit).view(np.int64), _WHOLE - 1)

    def part(self, n: int, first: np.ndarray, share: np.ndarray) -> None:
        code, wide = self.code[:n], self.unit * share.view(np.uint64)
        code -= self.unit * first.view(np.uint64)
        lanes = np.flatnonzero(wide < _SHORT)
        if len(lanes):
            used = self.used[lanes]
            code[lanes] = (code[lanes] << _32) | self.words[lanes, used]
            self.used[lanes] = used + 1
            wide[lanes] <<= _32
        self.range[:n] = wide


class Model:
    """What the lanes have learned so far: ``ask`` says what is expected of the next id of the first ``n``
    lanes, ``learn`` takes what it was."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.base = [lane * s for s in _SLOTS]
        #: Guess and, in the last three bits, trust.
        self.table = [np.zeros(lanes * s, np.int32) for s in _SLOTS]
        self.by = lane * 8, lane * 16, lane * 8
        self.two = np.full(lanes * 8, 1 << 14, np.int32)
        self.one = np.full(lanes * 16, 1 << 14, np.int32)
        self.alone = np.full(lanes * 8, 1 << 14, np.int32)
        self.weights = np.full((2, lanes), 1 << 15, np.int64)
        self.last, self.earlier = np.zeros((2, lanes), np.int64)

    def ask(self, n: int) -> None:
        mixed = self.last[:n] * 40_503
        self.at1 = ((mixed >> 3) & (_SLOTS[0] - 1)) + self.base[0][:n]
        self.at2 = (((mixed ^ (self.earlier[:n] * 60_493)) >> 2) & (_SLOTS[1] - 1)) + self.base[1][:n]
        self.entry1, self.entry2 = self.table[0].take(self.at1, mode="clip"), self.table[1].take(self.at2, mode="clip")
        self.guess1, self.guess2 = self.entry1 >> 3, self.entry2 >> 3
        self.trust1, self.trust2 = self.entry1 & 7, self.entry2 & 7
        self.same = self.guess1 == self.guess2
        # Order 2, mixed with what order 1 says of the same id.
        self.by2 = self.by[0][:n] + self.trust2
        self.by1 = self.by[1][:n] + (self.trust1 + (self.same.view(np.int8) << 3))
        self.count2, self.count1 = self.two.take(self.by2, mode="clip"), self.one.take(self.by1, mode="clip")
        self.hint2, self.hint1 = _STRETCH.take(self.count2 >> 4, mode="clip"), _STRETCH.take(self.count1 >> 4, mode="clip")
        mixed = (self.weights[0, :n] * self.hint2 + self.weights[1, :n] * self.hint1) >> 16
        self.chance2 = _SQUASH.take(mixed + 2048, mode="clip")
        # Order 1, where it says something else.
        self.by_alone = self.by[2][:n] + self.trust1
        self.count_alone = self.alone.take(self.by_alone, mode="clip")
        self.chance1 = (self.count_alone >> 4) * ~self.same

    def learn(self, n: int, found: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        """``right1`` tells whether the guess of order 1 was right, asked for or not."""
        goal = right2.view(np.int8) * np.int32(65_535)
        wrong = (right2.view(np.int8).astype(np.int32) << 12) - self.chance2
        weights = self.weights[:, :n]
        weights[0] += (self.hint2 * wrong) >> 10
        weights[1] += (self.hint1 * wrong) >> 10
        self.two[self.by2] = self.count2 + ((goal - self.count2) >> 5)
        self.one[self.by1] = self.count1 + ((goal - self.count1) >> 5)
        goal = right1.view(np.int8) * np.int32(_ALWAYS - _NEVER) + np.int32(_NEVER)
        asked = ~(right2 | self.same)
        self.alone[self.by_alone] = self.count_alone + ((goal - self.count_alone) >> 5) * asked
        fresh = (found << 3) + 1
        self.table[0][self.at1] = self._entry(self.entry1, self.trust1, right1, fresh)
        self.table[1][self.at2] = self._entry(self.entry2, self.trust2, right2, fresh)
        self.earlier, self.last = self.last, found.astype(np.int64)

    @staticmethod
    def _entry(entry: np.ndarray, trust: np.ndarray, right: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        case = trust + (right.view(np.int8) << 3)
        return np.where(case == 0, fresh, entry + _TRUST.take(case, mode="clip"))


#: What a wrong guess (first half; it is replaced where the trust is 0) and a right one add to the trust.
_TRUST = np.array([(t >> 1) - t for t in range(8)] + [1] * 7 + [0], np.int32)


def _lanes(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lanes, the longest first: the block, the lane's place in it, and the number of its ids."""
    counts = np.array([-(-n // LANE_IDS) for n in sizes])
    block = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(np.array(sizes)[block] - place * LANE_IDS, LANE_IDS)
    order = np.argsort(-size, kind="stable")
    return block[order], place[order], size[order]


def _active(size: np.ndarray) -> list[int]:
    """How many lanes have an id at each step."""
    return np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()


def _packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The order-0 counts of a block: steps between its ids and the counts, byte by byte."""
    steps = np.diff(ids.astype(np.int64), prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2)
    numbers = counts.astype("<u2").view(np.uint8).reshape(-1, 2)
    return zlib.compress(np.hstack([steps, numbers]).T.tobytes(), 6)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T)
    both = planes.view("<u2").astype(np.int64)
    return np.cumsum(both[:, 0]), both[:, 1]


def _escape(chance2: np.ndarray, chance1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 2**30, the shares of the guesses of order 2 and order 1."""
    share2 = chance2.astype(np.int64) << 18
    return share2, ((_WHOLE - share2) >> 12) * chance1


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of one to BLOCK_IDS ids below 2**16."""
    if not blocks:
        return []
    block, place, size = _lanes([len(b) for b in blocks])
    steps, lanes = int(size[0]), len(size)
    ids = np.zeros((steps, lanes), np.uint16)
    for k, (b, p, n) in enumerate(zip(block.tolist(), place.tolist(), size.tolist())):
        ids[:n, k] = blocks[b][p * LANE_IDS:p * LANE_IDS + n]
    # What the model expects, and which guesses are right: 2 or 3 for that of order 2, 1 for that of order 1.
    chances = np.zeros((2, steps, lanes), np.uint16)
    kind = np.full((steps, lanes), 2, np.uint8)
    model = Model(lanes)
    active = _active(size)
    for t, n in enumerate(active):
        model.ask(n)
        told = ids[t, :n].astype(np.int32)
        right2, right1 = told == model.guess2, told == model.guess1
        chances[0, t, :n], chances[1, t, :n] = model.chance2, model.chance1
        kind[t, :n] = right2.view(np.uint8) << 1 | right1.view(np.uint8)
        model.learn(n, told, right2, right1)
    # Order 0: the other ids of each block are counted; of each id, the counts before it and its own.
    ids, other = np.ascontiguousarray(ids.T), np.ascontiguousarray(kind.T == 0)
    place_of, table = np.zeros(ids.shape, np.uint32), np.zeros(1 << 16, np.uint32)
    headers, totals = [], np.ones(len(blocks), np.int64)
    by_block = np.argsort(block, kind="stable")
    for b, mine in enumerate(np.split(by_block, np.searchsorted(block[by_block], np.arange(1, len(blocks))))):
        here = ids[mine]
        # Sixteen-bit numbers are sorted by their digits.
        told = np.sort(here[other[mine]], kind="stable")
        begins = np.flatnonzero(np.diff(told.astype(np.int32), prepend=-1))
        counts = np.diff(begins, append=len(told))
        headers.append(_packed(told[begins], counts))
        table[told[begins]] = begins << 15 | counts
        place_of[mine] = table[here]
        totals[b] = max(1, len(told))
    place_of, total = np.ascontiguousarray(place_of.T), totals[block]

    coder = Encoder(lanes)
    for low in range(0, steps, 64):
        coder.room(64)
        high = min(steps, low + 64)
        share2, share1 = _escape(chances[0, low:high], chances[1, low:high])
        which = kind[low:high]
        begin = share2 + share1
        unit = (_WHOLE - begin) // total
        before, own = place_of[low:high] >> 15, place_of[low:high] & 0x7FFF
        first = np.where(which == 0, begin + unit * before, np.where(which >= 2, 0, share2)).view(np.uint64)
        share = np.where(which == 0, unit * own, np.where(which >= 2, share2, share1)).view(np.uint64)
        for t in range(low, high):
            n = active[t]
            coder.part(n, first[t - low, :n], share[t - low, :n])

    parts: list[list[np.ndarray]] = [[np.zeros(0, "<u4")] * -(-len(b) // LANE_IDS) for b in blocks]
    for b, p, words in zip(block.tolist(), place.tolist(), coder.finish()):
        parts[b][p] = words
    return [struct.pack("<H", len(h)) + h + np.array([len(w) for w in mine], "<u2").tobytes()
            + b"".join(w.tobytes() for w in mine) for h, mine in zip(headers, parts)]


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks with these payloads and numbers of ids."""
    if not payloads:
        return []
    block, place, size = _lanes(sizes)
    tables, streams = [], []
    for payload, n in zip(payloads, sizes):
        head = 2 + struct.unpack_from("<H", payload)[0]
        tables.append(_unpacked(payload[2:head]))
        many = -(-n // LANE_IDS)
        ends = np.cumsum(np.frombuffer(payload, "<u2", many, head))
        words = np.frombuffer(payload[head + 2 * many:], "<u4")
        streams.append(np.split(words, ends[:-1]))
    # Order 0: for each share of a block the number of its id, for each number id, share and count.
    names = np.concatenate([i for i, _ in tables] + [[0]])
    counts = np.concatenate([c for _, c in tables] + [[1]])
    befores = np.concatenate([np.cumsum(c) - c for _, c in tables] + [[0]])
    slots = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    totals = np.array([c.sum() for _, c in tables])
    base = (np.cumsum(totals) - totals)[block]
    total = np.maximum(totals, 1)[block]

    coder = Decoder([streams[b][p] for b, p in zip(block.tolist(), place.tolist())])
    model = Model(len(size))
    ids = np.zeros((int(size[0]), len(size)), np.uint16)
    for t, n in enumerate(_active(size)):
        if t % 64 == 0:
            coder.room(64)
        model.ask(n)
        share2, share1 = _escape(model.chance2, model.chance1)
        at = coder.place(n)
        guessed = share2 + share1
        right2, other = at < share2, np.flatnonzero(at >= guessed)
        found = np.where(right2, model.guess2, model.guess1)
        first, share = np.where(right2, 0, share2), np.where(right2, share2, share1)
        if len(other):
            begin = guessed[other]
            whole = total[other]
            unit = (_WHOLE - begin) // whole
            symbol = slots.take(np.minimum((at[other] - begin) // unit, whole - 1) + base[other])
            found[other] = names.take(symbol)
            first[other] = begin + unit * befores.take(symbol)
            share[other] = unit * counts.take(symbol)
        coder.part(n, first, share)
        model.learn(n, found, right2, found == model.guess1)
        ids[t, :n] = found
    ids = np.ascontiguousarray(ids.T)
    found = [np.zeros(n, np.uint16) for n in sizes]
    for k, (b, p, n) in enumerate(zip(block.tolist(), place.tolist(), size.tolist())):
        found[b][p * LANE_IDS:p * LANE_IDS + n] = ids[k, :n]
    return found


def checksum(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
