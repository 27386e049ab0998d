"""Five-word shingles of whole texts as hashed sets, and minwise tokens of such sets.

Plain numpy on one text at a time; Spark partitions the texts and calls these per batch.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
SKETCH = 36  # longs of seven hash ranges each
_EDGES = np.arange(7 * SKETCH, dtype=np.uint64) * np.uint64(2**64 // (7 * SKETCH))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """Word to 64-bit hash; emptied when it has met too many words to keep."""

    most = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """A-Z lower-cased words between ASCII white space, hashed, in order."""
    found = text.lower().split() if text else []
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def sequence(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of each shingle in order; fewer words make one shingle, none make none."""
    n = len(words)
    width = min(width, n)
    if not n:
        return words
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _STEP + words[k : n - width + 1 + k])
    return out


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(sequence(word_hashes(text), width))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that two sets share when they are equal."""
    low, high = shingles.sum(dtype=np.uint64), mix(shingles + _STEP).sum(dtype=np.uint64)
    return np.array([low, high], np.uint64).tobytes()


def multipliers(count: int, seed: int = 0) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * _STEP + np.uint64(seed)) | np.uint64(1)


def minwise(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each hash function the smallest value, as 32 bits; of a set that is not empty."""
    out = np.empty(len(factors), np.uint32)
    for i, f in enumerate(factors):
        out[i] = (shingles * f).min() >> np.uint64(32)
    return out.view(np.int32)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs of seven bytes: the smallest shingle of each range of hashes, as one
    byte from 1 to 255, or 0 for an empty range. Of a sorted set."""
    at = np.searchsorted(shingles, _EDGES)
    held = at < np.append(at[1:], len(shingles))
    values = np.zeros((SKETCH, 8), np.uint8)
    picked = ((shingles[at[held]] * _MIX1) >> np.uint64(56)) % np.uint64(255) + np.uint64(1)
    cells = np.zeros(7 * SKETCH, np.uint8)
    cells[held] = picked
    values[:, :7] = cells.reshape(SKETCH, 7)
    return values.view(np.int64).ravel()


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, of sorted sets without repeats."""
    if not len(a) or not len(b):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)
