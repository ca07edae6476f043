"""Word shingles of whole texts as sets of 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers[0][:n], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words between white space, all runs of `words`
    of them; a shorter text's whole sequence; nothing for a text without words."""
    raw = [(t or "").encode(errors="replace").lower() for t in texts]  # bytes.lower() changes A-Z only
    out = [np.empty(0, np.uint64)] * len(raw)
    flat = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    white = (flat == 32) | ((flat >= 9) & (flat <= 13))
    starts, ends = (np.flatnonzero(x) + 1 for x in (~white[1:] & white[:-1], white[1:] & ~white[:-1]))
    if not len(starts):
        return out
    power, inverse = _tables(len(flat))
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[flat] * power)])
    hashes = _mix((before[ends] - before[starts]) * inverse[starts])
    sizes = np.array([len(r) for r in raw])
    doc = np.searchsorted(np.cumsum(sizes + 1), starts, side="left")
    runs = hashes[: max(0, len(hashes) - words + 1)].copy()
    for k in range(1, words):
        runs = runs * _STEP + hashes[k : len(hashes) - words + 1 + k]
    runs = _mix(runs)
    counts = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(counts) - counts
    for d in np.flatnonzero(counts).tolist():
        n, a = int(counts[d]), int(first[d])
        if n >= words:
            out[d] = np.unique(runs[a : a + n - words + 1])
        else:
            x = np.full(1, n, np.uint64)
            for h in hashes[a : a + n]:
                x = _mix(x * _STEP + h)
            out[d] = x
    return out


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
