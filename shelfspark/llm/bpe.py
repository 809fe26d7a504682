"""A byte-pair vocabulary with word ends, and how texts fall into its words.

Facts used throughout. A word's encoding is the only sequence of tokens with its bytes in which
every token is the encoding of its own bytes and every adjacent pair is compatible, i.e. stays
apart when the pair alone is encoded. A pair is incompatible exactly if some piece on the right
edge of the first and some piece on the left edge of the second are both present when the merge
that joins them has its turn: formed earlier, and not yet part of something larger. Equal ranks go
from left to right, so the left one is gone and the right one is still there.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from itertools import islice

import numpy as np

from shelfspark.llm.spans import Piece

_NEVER = np.int64(1 << 40)
_FILTER_BITS = 20
#: Words whose encoding a task keeps at hand; a memo only, emptied when full.
MEMO_WORDS = 250_000
#: The same for words kept with their ids in arrays.
WORD_IDS = 500_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def special_strings(told: dict) -> dict[str, int]:
    """The special strings of a tokenizer file's content and their ids, if it is of the kind worked on here."""
    if (told["model"]["type"] != "BPE" or not told["model"]["end_of_word_suffix"]
            or any(t["normalized"] for t in told["added_tokens"])):
        raise ValueError("expected a BPE file with word ends and unnormalised special tokens")
    return {t["content"]: t["id"] for t in told["added_tokens"]}


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file; small enough to broadcast."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        self.end = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = special_strings(told)
        self.names |= {i: t for t, i in self.special.items()}
        of_byte = {c: b for b, c in enumerate(byte_characters())}
        size = max(self.names) + 1
        self.size = size
        self.rank = np.full(size, -1, np.int64)
        self.parts = np.full((size, 2), -1, np.int64)
        ids = model["vocab"]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merges[left * size + right] = (rank, whole)
            if self.rank[whole] >= 0 or max(self.rank[left], self.rank[right]) >= rank:
                raise ValueError("merges must make each token once, from tokens made before")
            self.rank[whole], self.parts[whole] = rank, (left, right)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in ids.items():
            closed = token.endswith(self.end) and len(token) > len(self.end)
            letters = token[:-len(self.end)] if closed else token
            (self.final if closed else self.inner)[bytes(of_byte[c] for c in letters)] = i
        self.base = [self.inner[bytes([b])] for b in range(256)]
        self.base_final = [self.final[bytes([b])] for b in range(256)]
        self._edges()
        for known, closed in ((self.inner, False), (self.final, True)):
            for letters in [x for x, i in known.items() if self.merged(x, closed) != [i]]:
                del known[letters]
        self.longest = max(map(len, [*self.inner, *self.final]))

    def _edges(self) -> None:
        """Per token the pieces along its right and left edge, and when each is used up."""
        tables = []
        for side in (1, 0):
            chain, until = [np.arange(self.size)], [np.full(self.size, _NEVER)]
            while True:
                held = chain[-1]
                below = np.where(held >= 0, self.parts[held, side], -1)
                if (below < 0).all():
                    break
                until.append(np.where(below >= 0, self.rank[held], -1))
                chain.append(below)
            tables.append((np.stack(chain, 1), np.stack(until, 1)))
        self.right_edge, self.left_edge = tables
        self.merge_keys = np.array(sorted(self.merges), np.int64)
        self.merge_ranks = np.array([self.merges[k][0] for k in self.merge_keys.tolist()], np.int64)
        self.merge_seen = np.zeros(1 << _FILTER_BITS, bool)
        self.merge_seen[self._slot(self.merge_keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart."""
        apart = np.ones(len(first), bool)
        (left, left_until), (right, right_until) = self.right_edge, self.left_edge
        for i in range(left.shape[1]):
            for j in range(right.shape[1]):
                a, b = left[first, i], right[second, j]
                keys = a * self.size + b
                maybe = np.flatnonzero((a >= 0) & (b >= 0) & self.merge_seen[self._slot(keys)])
                if not len(maybe):
                    continue
                keys = keys[maybe]
                at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
                there = self.merge_keys[at] == keys
                maybe, rank = maybe[there], self.merge_ranks[at[there]]
                joins = ((rank < left_until[first[maybe], i]) & (rank <= right_until[second[maybe], j])
                         & (rank > self.rank[a[maybe]]) & (rank > self.rank[b[maybe]]))
                apart[maybe[joins]] = False
        return apart

    def stays_apart(self, first: int, second: int) -> bool:
        """``compatible`` for one pair."""
        (left, left_until), (right, right_until) = self.right_edge, self.left_edge
        for a, a_until in zip(left[first].tolist(), left_until[first].tolist()):
            if a < 0:
                break
            for b, b_until in zip(right[second].tolist(), right_until[second].tolist()):
                if b < 0:
                    break
                found = self.merges.get(a * self.size + b)
                if found and max(self.rank[a], self.rank[b]) < found[0] < a_until and found[0] <= b_until:
                    return False
        return True

    def merged(self, word: bytes, closed: bool = True) -> list[int]:
        """Exact merging: the lowest rank first, equal ranks from the left."""
        ids = [self.base[b] for b in word]
        if closed:
            ids[-1] = self.base_final[word[-1]]
        n, size, merges = len(ids), self.size, self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get(ids[i] * size + ids[i + 1])
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, whole = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n:
                    found = merges.get(ids[left] * size + ids[right])
                    if found:
                        heapq.heappush(queue, (found[0], left, ids[left], ids[right], found[1]))
        return [i for i in ids if i >= 0]

    def longest_match(self, word: bytes) -> list[int]:
        """The proposal: from the left, always the longest token that fits."""
        found, at, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while at < n:
            rest = n - at
            token = final.get(word[at:]) if rest <= longest else None
            step = rest
            if token is None:
                step = min(longest, rest - 1)
                while (token := inner.get(word[at:at + step])) is None:
                    step -= 1
            found.append(token)
            at += step
        return found

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Proposals of all words, checked pair by pair at once; failing words are merged."""
        proposed = [self.longest_match(w) for w in words]
        sizes = np.array([len(p) for p in proposed], np.int64)
        flat = np.array([t for p in proposed for t in p], np.int64)
        if len(flat) < 2:
            return proposed
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        for k in np.unique(owner[inside[bad]]).tolist():
            proposed[k] = self.merged(words[k])
        return proposed


#: White space of the tokenizer's patterns (a fixed value: Unicode's White_Space).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
#: Code points no text can hold; each stands for a special string.
_FIRST_MARK = 0xD800
_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)],
                         np.uint8)
        table[WHITE_SPACE] = SPACE
        table[0xD800:0xE000] = SPECIAL
        _classes.append(table)
    return _classes[0]


def _members(kinds: tuple[int, ...], below: int) -> str:
    """The code points of some classes, as a regular expression writes them in brackets."""
    member = np.isin(class_table()[:below], kinds)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], member.view(np.int8), [0]))))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


_patterns: dict[int, re.Pattern] = {}


def word_pattern(below: int = 0x110000) -> re.Pattern:
    """The words of a normal text with code points below a bound: a lone apostrophe takes s, t, re, ve, m,
    ll or d with it; else runs of letters, single numbers and special strings, and runs of what is
    neither these nor white space. Brackets up to 0x10000 are bit tables, larger ones are searched."""
    if below not in _patterns:
        letter, single, rest = (_members(k, below) for k in ((LETTER,), (NUMBER, SPECIAL), (OTHER,)))
        _patterns[below] = re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{rest}]+|[{single}]")
    return _patterns[below]


def words_of(text: str) -> list[str]:
    """The words of a normal text."""
    plain = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
    return word_pattern(0x10000 if plain else 0x110000).findall(text)


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Splitter:
    """Cuts the texts of a piece into the words that are encoded alone."""

    def __init__(self, special: dict[str, int]) -> None:
        self.marks = {s: chr(_FIRST_MARK + k) for k, s in enumerate(special)}
        self.special = {m: special[s] for s, m in self.marks.items()}

    def normal(self, text: str) -> str:
        if "<|" in text:
            for name, mark in self.marks.items():
                text = text.replace(name, mark)
        if not text.isascii():
            # Letter by letter: no special form of a capital sigma at the end of a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split(self, piece: Piece, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word; words before each text."""
        raw, edges = piece.bytes.tobytes(), piece.edges.tolist()
        codes, sizes = [np.zeros(0, np.int64)], [0]
        for a, b in zip(edges, edges[1:]):
            found = words_of(self.normal(raw[a:b - 1].decode()))
            codes.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
            sizes.append(len(found))
        return np.concatenate(codes), np.cumsum(sizes)


class WordIds:
    """Ids of the words met so far, one after another in ``flat``; emptied when full."""

    def __init__(self, special: dict[str, int], encode: Callable) -> None:
        self.splitter, self.encode = Splitter(special), encode
        self._clear()

    def _clear(self) -> None:
        self.numbers = Numbers()
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a piece, and where each text's ids begin (one more for the end)."""
        if len(self.numbers) > WORD_IDS:
            self._clear()
        done = len(self.numbers)
        codes, bounds = self.splitter.split(piece, self.numbers)
        special = self.splitter.special
        fresh = list(islice(self.numbers, done, None))
        plain = iter(self.encode([w.encode() for w in fresh if w not in special]))
        flat, sizes = [], []
        for w in fresh:
            ids = [special[w]] if w in special else next(plain)
            flat += ids
            sizes.append(len(ids))
        self.sizes = np.concatenate((self.sizes, np.array(sizes, np.int64)))
        self.flat = np.concatenate((self.flat, np.array(flat, np.int32)))
        counts = self.sizes[codes]
        total = np.concatenate(([0], np.cumsum(counts)))
        # Position of each id in `flat`: its word's begin plus its place in the word.
        begins = (np.cumsum(self.sizes) - self.sizes)[codes]
        places = np.arange(total[-1]) - np.repeat(total[:-1] - begins, counts)
        return self.flat[places], total[bounds]


class Memo:
    """Encodings of words met before, each with what the caller derives from its ids."""

    def __init__(self, vocabulary: Vocabulary, derive: Callable,
                 encode: Callable | None = None, special: Callable | None = None) -> None:
        self.derive = derive
        self.special = special or (lambda i: derive([i]))
        self.splitter = Splitter(vocabulary.special)
        self.encode = encode or vocabulary.encode_words
        self.known: dict[str, object] = {}

    def __call__(self, piece: Piece) -> tuple[np.ndarray, list, np.ndarray]:
        """Per word of the piece the number of its distinct word; what is derived from each
        distinct word; the words before each text."""
        numbers = Numbers()
        codes, bounds = self.splitter.split(piece, numbers)
        words = list(numbers)
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        known, special = self.known, self.splitter.special
        fresh = [w for w in words if w not in known]
        plain = [w for w in fresh if w not in special]
        for w, ids in zip(plain, self.encode([w.encode() for w in plain])):
            known[w] = self.derive(ids)
        for w in set(fresh) & special.keys():
            known[w] = self.special(special[w])
        return codes, [known[w] for w in words], bounds
