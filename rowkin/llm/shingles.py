"""Sets of five-word shingles as 64-bit hashes, and min-hash sketches of them. Runs inside tasks."""

from __future__ import annotations

import hashlib
import numpy as np
import xxhash

SHINGLE_WORDS = 5
CACHED_WORDS = 200_000
SLICE = 4_096  # shingles hashed at once, so that a very long text needs no more memory than a short one

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hash per word; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; fewer than five words make one shingle, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    value = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        value = value * _STEP + h[i: len(words) - width + 1 + i]
    return np.unique(mixed(value))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Sketcher:
    """Min-hashes in two collections of ``halves`` half keys, each of ``per_half`` min-hashes."""

    def __init__(self, halves: int, per_half: int):
        seeds = np.random.default_rng(20_240_601)
        count = 2 * halves * per_half
        self.halves, self.per_half = halves, per_half
        self.factor = (seeds.integers(0, 2**32, (count, 1), np.uint32) | np.uint32(1)).astype(np.uint32)
        self.shift = seeds.integers(0, 2**32, (count, 1), np.uint32)

    def half_keys(self, shingles: np.ndarray) -> np.ndarray:
        """2 * halves keys as int64. The lowest bit names the collection, the rest hashes number and min-hashes."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.factor), 2**32 - 1, np.uint32)
        for start in range(0, len(x), SLICE):
            np.minimum(low, (x[None, start: start + SLICE] * self.factor + self.shift).min(axis=1), out=low)
        groups = low.reshape(2 * self.halves, self.per_half).astype(np.uint64)
        key = np.arange(2 * self.halves, dtype=np.uint64)
        for i in range(self.per_half):
            key = mixed(key * _STEP + groups[:, i])
        side = (np.arange(2 * self.halves) >= self.halves).astype(np.uint64)
        return ((key & ~np.uint64(1)) | side).view(np.int64)


class Signer:
    """Four bits of each of 512 min-hashes as 32 longs: long 4 * w + i holds bit i of min-hashes 64 * w to 64 * w + 63."""

    LANES = 512

    def __init__(self):
        self.hashes = Sketcher(self.LANES // 2, 1)
        self.weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def planes(self, shingles: np.ndarray) -> np.ndarray:
        low = self.hashes.half_keys(shingles).view(np.uint64).reshape(-1, 1, 64)
        bits = (low >> np.arange(8, 12, dtype=np.uint64).reshape(1, 4, 1)) & np.uint64(1)
        return (bits * self.weights).sum(axis=2, dtype=np.uint64).reshape(-1).view(np.int64)


def overlap(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted sets of distinct values."""
    both = np.concatenate((left, right))
    both.sort()
    return int((both[1:] == both[:-1]).sum())

