"""Hashed features of texts for the trained models, in numpy.

A word's features are itself and its beginnings, so that inflected forms of a
stem share some. What a text has of a feature is the number of its distinct
words with it. A worker computes a word's features once and remembers them.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

DIMS = 1 << 18
LETTERS = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers; the memory is emptied when full.
CACHE = 300_000


def words(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    return LETTERS.findall(text.lower()) if text else []


def word_features(word: str, dims: int = DIMS) -> list[int]:
    """The word, and its first 4, 5 and 6 letters."""
    marked = f"<{word}"
    digest = xxhash.xxh3_64_intdigest
    return [digest(g) & (dims - 1) for g in {f"{marked}>", marked[:5], marked[:6], marked[:7]}]


class WordFeatures(dict):
    """word -> its features, by their new number if ``places`` has one for each feature that counts (-1: it doesn't)."""

    def __init__(self, places: np.ndarray | None = None) -> None:
        super().__init__()
        self.places = places

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = word_features(word)
        if self.places is not None:
            found = [p for p in self.places[found].tolist() if p >= 0]
        self[word] = found = tuple(found)
        return found

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's features and how many of its distinct words have each."""
        found = [f for w in set(words(text)) for f in self[w]]
        return np.unique(np.array(found, np.int64), return_counts=True)
