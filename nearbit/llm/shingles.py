"""Word shingles as 64-bit hashes, and circulant MinHash signatures, in numpy.

A signature coordinate k is the minimum over a set of pi[(sigma(x) + k) mod D]:
sigma scatters the hashes over D positions, and one fixed permutation pi,
shifted by k, serves as the k-th hash function. Two permutations make all
coordinates, and those of one element are neighbours in memory.
"""

from __future__ import annotations

import re
import string

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Words whose hash a worker remembers; the memory is emptied when full.
CACHE = 400_000
#: Positions of the circulant universe, a power of two.
POSITIONS = 1 << 20
#: Shingles whose signature rows are held at a time.
BLOCK = 40_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, with a bound on what is kept."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def words(text: str | None) -> list[str]:
    """Words in ASCII lower case; null has none."""
    if not text:
        return []
    return WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))


def word_hashes(found: list[str], memory: WordHashes) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, found), np.uint64, len(found))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words, in order; of fewer words, but not none, one for all."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = mix(h[: len(h) - k + 1] + np.uint64(k))
    for i in range(1, k):
        out = mix(out + h[i : len(h) - k + 1 + i] * _M1)
    return out


def shingle_set(text: str | None, n: int, memory: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(words(text), memory), n))


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


class Circulant:
    """Signatures of ``coords`` coordinates from two permutations."""

    def __init__(self, coords: int, seed: int = 20_231, positions: int = POSITIONS) -> None:
        rng = np.random.default_rng(seed)
        pi = rng.permutation(positions).astype(np.uint32)
        self.sigma = np.uint64(rng.integers(1, 1 << 63) * 2 + 1)
        self.shift = np.uint64(64 - (positions.bit_length() - 1))
        self.coords = coords
        self.rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coords - 1]]), coords)

    def rows_of(self, shingles: np.ndarray) -> np.ndarray:
        return self.rows[(shingles * self.sigma) >> self.shift]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(self.coords, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(shingles), BLOCK):
            np.minimum(out, self.rows_of(shingles[i : i + BLOCK]).min(axis=0), out=out)
        return out


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
