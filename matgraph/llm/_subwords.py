"""Letters of words and hashed features of their parts, for many words at once."""

from __future__ import annotations

import re

import numpy as np

_OTHER = re.compile(r"[\W\d_]+")


def letters(word: bytes) -> str:
    core = _OTHER.sub("", word.decode("utf-8", "replace").lower())
    if core and not core.isalpha():  # fractions, powers and the like are left
        core = "".join(filter(str.isalpha, core))
    return core


def hashed(cores: list[str], grams: tuple[int, ...], affixes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, feature) pairs: letter n-grams of those lengths with word
    borders, and prefixes and suffixes of those lengths."""
    points = np.frombuffer("".join(f"<{c}>" for c in cores).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, cores), np.int64, len(cores)) + 2
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(cores)), n)
    left = np.repeat(first + n, n) - np.arange(len(points))  # characters from here to the word's end
    found = [(np.empty(0, np.int64), np.empty(0, np.uint64))]

    def add(kind: int, at: np.ndarray, length: int) -> None:
        h = np.full(len(at), kind + 1, np.uint64)
        for i in range(length):
            h = (h ^ points[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        found.append((word[at], (h >> np.uint64(40)) & np.uint64(buckets - 1)))

    for length in grams:
        add(0, np.flatnonzero(left >= length), length)
    for length in affixes:
        fits = n - 2 >= length
        add(1, first[fits] + 1, length)
        add(2, (first + n)[fits] - 1 - length, length)
    return np.concatenate([w for w, _ in found]), np.concatenate([f for _, f in found]).astype(np.int64)


def sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by index."""
    return np.stack([np.bincount(index, rows[:, c], n) for c in range(rows.shape[1])], axis=1)


def picked_sums(index: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``sums(index, rows[at], n)``, without all those rows at once."""
    return np.stack([np.bincount(index, np.ascontiguousarray(rows[:, c])[at], n) for c in range(rows.shape[1])], axis=1)
