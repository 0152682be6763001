"""Words and word shingles of whole batches of texts, as numpy arrays.

A *word* is a maximal run of ``a-z0-9`` after lower-casing; everything else only
separates.  Words and shingles are represented by 64-bit hashes computed for a
whole batch at once: a polynomial prefix sum over the bytes gives every word's
hash by two subtractions, so no Python loop touches single words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_STEP = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
CHUNK = 1 << 18

_powers: list[np.ndarray] = []


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; spreads the weak low bits of polynomial hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many ranges; equal contents give equal hashes anywhere."""
    up, down = _pow_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def normal_bytes(text: str) -> bytes:
    """Lower-cased text with every byte outside a-z0-9 turned into a blank."""
    return text.lower().encode("ascii", "replace").translate(_TABLE)


def word_list(text: str | None) -> list[str]:
    """The words of one text; none for a null."""
    return normal_bytes(text).decode("ascii").split() if text else []


class Batch:
    """Words of several texts: hashes ``word`` and, per text, the range ``first[i]:first[i+1]``."""

    __slots__ = ("first", "word")

    def __init__(self, texts: Sequence[str | None]):
        parts = [normal_bytes(t) if t else b"" for t in texts]
        raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        letter = raw != 32
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        self.word = range_hash(raw, start, end)
        begins = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)), out=begins[1:])
        self.first = np.searchsorted(start, begins + 1)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words (with repeats, in order) and the text range of each."""
        n = self.counts()
        many = np.maximum(n - width + 1, 0)
        first = np.zeros(len(n) + 1, np.int64)
        np.cumsum(many, out=first[1:])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], many)
        acc = np.zeros(len(at), np.uint64)
        for k in range(width):
            acc = (acc ^ self.word[at + k]) * np.uint64(_STEP[k % 3])
            acc ^= acc >> np.uint64(31)
        return mix(acc), first


def chunks(texts: Sequence[str | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts holding about ``size`` characters, whole texts only."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1 if t else 1
        if total >= size:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def shingle_set(text: str | None, width: int) -> set[tuple[str, ...]]:
    """The exact distinct shingles of one text, for verification."""
    w = word_list(text)
    return set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else set()
