"""Byte-pair encoding by last-token states, and caches of what the tokenizers library gives.

The encoding of a prefix is fixed by its last token and the encoding of what stands before it. A token ends the encoding
of a prefix exactly when the last token before it and the token, encoded together, stay two tokens. So what the rest of a
word can still depend on are the places behind which a longer token of the vocabulary may have begun, with the last token
before each: a state of a deterministic automaton, which is compiled from the vocabulary as its states are met.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .words import SPACE, WHITE, Batch, Kinds, WordTable

#: Slots of a worker's table of words, as a power of two; a slot takes 24 bytes, and a word's ids a few more.
BITS = 20
#: States of an automaton after which it is compiled anew, and pairs of tokens that it remembers.
STATES, PAIRS = 100_000, 100_000
#: A final symbol is the byte and this.
FINAL = 256
#: Behind all merges.
NONE = 1 << 60
_COUNT, _TOKEN = 12, 20  # bits of a state's entry: node of the vocabulary's trie, token before, tokens up to there


def _unassigned() -> Callable[[str], object]:
    """Finds characters that this Python's Unicode doesn't know, as a later one may, and all beyond the first plane."""
    known = [unicodedata.category(chr(c)) not in ("Cn", "Cs") for c in range(1 << 16)] + [True]
    cuts = [c for c in range(1, 1 << 16) if known[c] != known[c - 1]] + [1 << 16]
    spans = [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False) if not known[a]]
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans) + "\U00010000-\U0010ffff]").search


_suspect = _unassigned()


def settled(text: str) -> bool:
    """Whether Python's character classes are the library's for this text: they differ on characters that only one of them knows."""
    return text.isascii() or _suspect(text) is None or all(unicodedata.category(c) != "Cn" for c in set(text))


def byte_chars() -> dict[str, str]:
    """Character of byte-level vocabularies -> the byte as a latin-1 character: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


def special_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of a vocabulary's file; its model, behind them, is not parsed."""
    at = vocabulary.index('"added_tokens"')
    found, _ = json.JSONDecoder().raw_decode(vocabulary, vocabulary.index("[", at))
    return {t["content"]: t["id"] for t in found}


class Automaton:
    """Last-token states of a byte-level vocabulary. Symbols are bytes, and with FINAL added a word's last byte where the
    vocabulary marks the ends of words.

    keys has for each state the places behind which a token may go on: the node that the bytes since have reached, the
    token before the place, and how many tokens more than at the state's own end there are. step() compiles one transition.
    """

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]  # about 30 MB, which go when the tables are made
        chars, end = byte_chars(), model.get("end_of_word_suffix") or ""
        self.end, ids = bool(end), model["vocab"]
        self.symbols: dict[int, list[int]] = {}
        self.one: dict[int, int] = {}
        for t, i in ids.items():
            final = bool(end) and t.endswith(end) and t != end
            own = [ord(chars[c]) for c in (t[: -len(end)] if final else t)] if final or t != end else []
            if final:
                own[-1] += FINAL
            if own:
                self.symbols[i] = own
                if len(own) == 1:
                    self.one[own[0]] = i
        self.sizes = {i: len(s) for i, s in self.symbols.items()}
        self.merges: dict[int, int] = {}  # two tokens in one number -> rank and new token in one number
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] << _TOKEN | ids[b]] = rank << _TOKEN | ids[a + b]
        if max(self.sizes.values()) >= 1 << _COUNT - 1 or max(ids.values()) + 2 >= 1 << _TOKEN:
            raise ValueError("the vocabulary is too large for the states")
        self.child: dict[int, int] = {}
        self.token, self.more = [-1], [True]
        for i, own in self.symbols.items():
            at = 0
            for s in own:
                self.more[at] = True
                if (to := self.child.get(at << 9 | s)) is None:
                    to = self.child[at << 9 | s] = len(self.token)
                    self.token.append(-1)
                    self.more.append(False)
                at = to
            self.token[at] = i
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the one at the start of a word, 0."""
        start = (1 << _COUNT - 1,)
        self.keys, self.states, self.last = [start], {start: 0}, [-1]

    def merge(self, symbols: list[int]) -> list[int]:
        """The merges of least rank first, the leftmost of equals."""
        while len(symbols) > 1:
            ranks = [self.merges.get(a << _TOKEN | b, NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
            if (best := min(ranks)) == NONE:
                break
            i = ranks.index(best)
            symbols = [*symbols[:i], best & (1 << _TOKEN) - 1, *symbols[i + 2 :]]
        return symbols

    def stays(self, before: int, token: int) -> bool:
        """Whether the two tokens, encoded together, stay as they are; before is -1 at the start of a word."""
        key = before + 1 << _TOKEN | token
        if (v := self.pairs.get(key)) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            both = [before, token] if before >= 0 else [token]
            v = self.pairs[key] = self.merge([self.one[s] for t in both for s in self.symbols[t]]) == both
        return v

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state after a symbol, and how many tokens more there are than before it."""
        kept, found, count, low = [], -1, 0, (1 << _TOKEN + _COUNT) - 1
        for e in self.keys[state]:  # the longest token first
            if (to := self.child.get(e >> _TOKEN + _COUNT << 9 | symbol)) is None:
                continue
            if found < 0 and (t := self.token[to]) >= 0 and self.stays(((e & low) >> _COUNT) - 1, t):
                found, count = t, (e & (1 << _COUNT) - 1) - (1 << _COUNT - 1) + 1
            if self.more[to]:
                kept.append(to << _TOKEN + _COUNT | e & low)
        if found < 0:
            raise ValueError("the vocabulary lacks a byte")
        key = (*(e - count for e in kept), found + 1 << _COUNT | 1 << _COUNT - 1)
        if (new := self.states.get(key)) is None:
            new = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.last.append(found)
        return new, count


class PrefixBpe:
    """Encodes words by a depth-first walk of the trie of all of them."""

    def __init__(self, vocabulary: str):
        self.automaton = Automaton(vocabulary)
        self.edges: dict[int, int] = {}

    def _step(self, state: int, symbol: int) -> int:
        to = self.edges[state << 9 | symbol] = self.automaton.step(state, symbol)[0]
        return to

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each distinct word. Sorted words are a depth-first walk of their trie: what a word shares with the one
        before it is a path that has been walked, and the states on it are kept."""
        a = self.automaton
        if len(a.keys) > STATES:
            a.reset()
            self.edges.clear()
        out: dict[bytes, list[int]] = {}
        path, before, get, last, sizes, end = [0], b"", self.edges.get, a.last, a.sizes, a.end
        for word in sorted(set(words)):
            n, i = len(word), 0
            stop = n - 1 if end else n
            top = min(stop, len(path) - 1)
            while i < top and word[i] == before[i]:
                i += 1
            del path[i + 1 :]
            state = path[i]
            for c in word[i:stop]:
                to = get(state << 9 | c)
                state = self._step(state, c) if to is None else to
                path.append(state)
            before = word
            ids, at = [], n
            if end and n:
                c = word[-1] + FINAL
                to = get(state << 9 | c)
                t = last[self._step(state, c) if to is None else to]
                ids.append(t)
                at -= sizes[t]
            while at:
                t = last[path[at]]
                ids.append(t)
                at -= sizes[t]
            ids.reverse()
            out[word] = ids
        return out


class WordCodec:
    """Encoding and decoding with a vocabulary of words that end in a marker, in lower case and without white space.

    The words of a batch of texts that the table lacks are encoded together by their trie. Special tokens cut a text.
    """

    def __init__(self, vocabulary: str, bits: int = BITS):
        self.library = Tokenizer.from_str(vocabulary)
        self.bpe = PrefixBpe(vocabulary)
        self.special = special_tokens(vocabulary)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        kind = np.dtype("<u2" if self.library.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.shown = pa.array([self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size(True))])
        self.kinds, self.table = Kinds(), WordTable(kind, bits)

    def plain(self, text: str) -> str:
        """A text as the vocabulary's normalizer gives it, but for white space."""
        if not settled(text):
            return self.library.normalizer.normalize_str(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() has a form of its own for the last one of a word
        return text.lower()

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts without special tokens, one after the other, and where each text's begin."""
        batch = Batch(list(map(self.plain, texts)), self.kinds)
        cuts = np.flatnonzero(batch.word_cuts())
        kinds = batch.kinds[cuts]
        words = np.flatnonzero((kinds != SPACE) & (kinds != WHITE))
        starts, ends, raw = batch.at[cuts[words]], batch.at[np.append(cuts[1:], len(batch.codes))[words]], batch.raw
        whole = raw.tobytes()

        def encode(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
            own = [whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            codes = self.bpe.encode_words(own)
            return [codes[w] for w in own]

        ids, sizes = self.table.ids(raw, starts, ends, encode)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        return ids, upto[np.searchsorted(cuts[words], batch.texts)]

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The ids of all texts one after the other, where each text's begin, and the decoded texts."""
        if any(s in t for s in self.special for t in texts):
            parts = [self.cut(t) for t in texts]
            ids, begins = self.ids([p for ps in parts for p in ps[::2]])
            own = iter(np.split(ids, begins[1:-1]))
            out = []
            for ps in parts:
                for i, p in enumerate(ps):
                    out.append(np.array([self.special[p]], ids.dtype) if i % 2 else next(own))
            sizes = np.cumsum([0, *map(len, out)])
            ids, begins = np.concatenate(out), sizes[np.cumsum([0, *map(len, parts)])]
        else:
            ids, begins = self.ids(texts)
        return ids, begins, pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), self.shown.take(pa.array(ids))), " ")


class ByteCodec:
    """What the tokenizers library gives for a byte-level vocabulary: a batch of texts is cut into words by the vocabulary's
    pattern, and the library's model encodes each distinct word that the table lacks. Texts with a special token go to the
    library whole."""

    def __init__(self, vocabulary: str, bits: int = BITS):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = list(special_tokens(vocabulary))
        kind = np.dtype("<u2" if self.library.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.kinds, self.table = Kinds(), WordTable(kind, bits)
        shown = np.empty(256, "<u2")
        for c, b in byte_chars().items():
            shown[ord(b)] = ord(c)
        self.shown = shown

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts without special tokens, one after the other, and where each text's begin."""
        batch = Batch(texts, self.kinds)
        cuts = np.flatnonzero(batch.byte_cuts())
        starts, ends, raw, tokenize = batch.at[cuts], batch.at[np.append(cuts[1:], len(batch.codes))][: len(cuts)], batch.raw, self.library.model.tokenize

        def encode(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
            size = b - a
            upto = np.cumsum(size)
            chars = self.shown[raw[np.repeat(a - (upto - size), size) + np.arange(int(upto[-1]))]].tobytes().decode("utf-16-le")
            return [[t.id for t in tokenize(chars[x:y])] for x, y in zip((upto - size).tolist(), upto.tolist(), strict=True)]

        ids, sizes = self.table.ids(raw, starts, ends, encode)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        return ids, upto[np.searchsorted(cuts, batch.texts)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin."""
        easy = [not any(map(t.__contains__, self.special)) for t in texts]
        ids, begins = self.ids([t for t, e in zip(texts, easy, strict=True) if e])
        if all(easy):
            return ids, begins
        own = iter(np.split(ids, begins[1:-1]))
        out = [next(own) if e else np.array(self.library.encode(t, add_special_tokens=False).ids, ids.dtype) for t, e in zip(texts, easy, strict=True)]
        return np.concatenate([np.empty(0, ids.dtype), *out]), np.cumsum([0, *map(len, out)])
