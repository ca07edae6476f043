"""Words of many texts at once, cut as the vocabularies' patterns cut them, and a table of what is known of words.

The patterns tell letters, numbers, white space and marks apart, and where they cut hangs on a few characters at most. So
the kinds of all characters of a batch are looked up in one table, and the cuts follow from comparing neighbours.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

LETTER, NUMBER, SPACE, WHITE, MARK, UNKNOWN = range(6)
_POWER, _TABLES = 0x9E3779B97F4A7C15, np.random.default_rng(99).integers(0, 2**64, (2, 256), dtype=np.uint64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


class Kinds:
    """The kind of each character, as the library's patterns see it: it is asked once for each character that is met."""

    def __init__(self):
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.ask = [(k, Split(Regex(p), "removed").pre_tokenize_str) for k, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s"))]
        self.table[32] = SPACE

    def of(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.table[codes]
        if (new := kinds == UNKNOWN).any():
            for c in np.unique(codes[new]).tolist():
                self.table[c] = next((k for k, split in self.ask if not split(chr(c))), MARK)
            kinds = self.table[codes]
        return kinds


class Batch:
    """Texts one after the other: raw bytes, code points, kinds, where in bytes each character begins, and in bytes and
    characters each text."""

    def __init__(self, texts: list[str], kinds: Kinds):
        joined = "".join(texts)
        self.raw = np.frombuffer(joined.encode(), np.uint8)
        self.codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        self.kinds = kinds.of(self.codes)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.texts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        at = np.arange(len(self.raw)) if len(self.raw) == len(self.codes) else np.flatnonzero((self.raw & 0xC0) != 0x80)
        self.at = np.append(at, len(self.raw))
        self.first = np.zeros(len(self.codes) + 1, bool)
        self.first[self.texts] = True  # and behind the last character

    def _contractions(self, starts: np.ndarray, begins: np.ndarray) -> None:
        """Behind apostrophes at starts: 's 't 'm 'd 're 've 'll are words, and another begins behind each."""
        c = np.append(self.codes, np.zeros(3, np.uint32))
        first = np.append(self.first, np.ones(2, bool))
        i = starts[(c[starts] == 39) & ~first[starts + 1]]
        one, two = c[i + 1], np.where(first[i + 2], 0, c[i + 2])
        short = np.isin(one, (ord("s"), ord("t"), ord("m"), ord("d")))
        long = np.isin(one, (ord("r"), ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[i[short | long] + 1] = False
        end = np.concatenate([i[short] + 2, i[long] + 3])
        begins[end[end < len(begins)]] = True

    def byte_cuts(self) -> np.ndarray:
        """For each character whether a word of the byte-level pattern begins there; its words leave nothing out.

        The last of several white characters before another kind stands apart, and if it is a space, it begins the word.
        """
        k, n = self.kinds, len(self.codes)
        if not n:
            return np.empty(0, bool)
        white = (k == SPACE) | (k == WHITE)
        same = np.where(white, SPACE, k)
        begins = self.first[:-1].copy()
        begins[1:] |= same[1:] != same[:-1]
        begins[:-1] |= white[:-1] & ~white[1:] & ~self.first[1:-1]
        begins[1:] &= white[1:] | (k[:-1] != SPACE) | self.first[1:-1]
        self._contractions(np.flatnonzero(begins & (self.codes == 39)), begins)
        return begins

    def word_cuts(self) -> np.ndarray:
        """For each character whether a word of the pattern of words, or white space between two, begins there; numbers are words one by one."""
        k, n = self.kinds, len(self.codes)
        if not n:
            return np.empty(0, bool)
        same = np.where(k == WHITE, SPACE, k)
        begins = self.first[:-1] | (k == NUMBER)
        begins[1:] |= same[1:] != same[:-1]
        self._contractions(np.flatnonzero(begins & (self.codes == 39)), begins)
        return begins


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of runs of bytes, of which the second is never 0."""
    global _powers
    if len(_powers[0]) <= len(raw):
        size = max(len(raw) + 1, 1 << 20)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_POWER, pow(_POWER, -1, 1 << 64)))
    out = []
    for table in _TABLES:
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw] * _powers[0][: len(raw)])])
        h = (upto[ends] - upto[starts]) * _powers[1][starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(29)))
    return out[0], out[1] | np.uint64(1)


class WordTable:
    """Ids of words by their hashes, in a table of fixed size with open addresses; when it is 60 % full it is emptied."""

    def __init__(self, kind: np.dtype, bits: int = 21):
        self.kind, self.mask = kind, np.uint64((1 << bits) - 1)
        self.most = (1 << bits) * 6 // 10
        self.clear()

    def clear(self) -> None:
        n = int(self.mask) + 1
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.begin, self.size = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.pool, self.used, self.entries = np.empty(1 << 16, self.kind), 0, 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each word, or -1."""
        out = np.full(len(key), -1, np.int64)
        left, slot = np.arange(len(key)), key & self.mask
        while len(left):
            there = self.check[slot]
            hit = (there == check[left]) & (self.key[slot] == key[left])
            out[left[hit]] = slot[hit].astype(np.int64)
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def add(self, key: np.ndarray, check: np.ndarray, codes: list[list[int]]) -> None:
        """Distinct new words with their ids."""
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.fromiter((i for c in codes for i in c), self.kind, int(sizes.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(len(self.pool) + len(flat), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.entries += len(key)
        left, slot = np.arange(len(key)), key & self.mask
        while len(left):
            free = np.flatnonzero(self.check[slot] == 0)
            s, nth = np.unique(slot[free], return_index=True)  # one word for each free slot
            won = left[free[nth]]
            self.key[s], self.check[s], self.begin[s], self.size[s] = key[won], check[won], begin[won], sizes[won]
            rest = np.ones(len(left), bool)
            rest[free[nth]] = False
            left, slot = left[rest], slot[rest]
            slot = np.where(self.check[slot] != 0, (slot + np.uint64(1)) & self.mask, slot)

    def ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words raw[start:end], one after the other, and how many each has. encode gives the ids of distinct
        words, from the starts and ends of one of each."""
        key, check = hashes(raw, starts, ends)
        slot = self.find(key, check)
        if (lack := np.flatnonzero(slot < 0)).size:
            _, nth = np.unique(key[lack], return_index=True)
            one = lack[nth]
            if self.entries + len(one) > self.most:
                if 2 * len(one) > self.most:  # more new words than the table may hold: half of the batch at a time
                    half = len(starts) // 2
                    parts = [self.ids(raw, starts[a:b], ends[a:b], encode) for a, b in ((0, half), (half, len(starts)))]
                    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                self.clear()
                _, nth = np.unique(key, return_index=True)
                lack, one = np.arange(len(key)), nth
            self.add(key[one], check[one], encode(starts[one], ends[one]))
            slot[lack] = self.find(key[lack], check[lack])
        begin, size = self.begin[slot].astype(np.int64), self.size[slot].astype(np.int64)
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        return self.pool[np.repeat(begin - (upto - size), size) + np.arange(total)], size
