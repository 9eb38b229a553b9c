"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
N_WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        room = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(room, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[k] = np.cumprod(table, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def run_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end) of a byte array, all at once."""
    up, down = _powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, dtype=np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the number of words of each."""
    body = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[body]
    edge = np.diff(np.concatenate([[1], space.astype(np.int8)]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    stops = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, stops)]))
    return run_hashes(body, starts, ends), counts


def shingles_of(words: np.ndarray, counts: np.ndarray, width: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text in order, and their number.

    A text of fewer words than ``width`` has one shingle of all its words, one without words has none.
    """
    n = len(words)
    total = np.zeros(n, dtype=np.uint64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end of the text
    factor = 1
    for k in range(width):
        part = words[k:] * np.uint64(factor)
        within = left[: n - k] > k
        total[: n - k] += np.where(within, part, np.uint64(0))
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    first = np.arange(n) == np.repeat(np.cumsum(counts) - counts, counts)
    keep = (left >= width) | first
    total = mix(total + np.minimum(left, width).astype(np.uint64))
    return total[keep], np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))


def shingle_sets(texts: list[bytes], width: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one text after another, and their number."""
    values, counts = shingles_of(*words_of(texts), width)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(texts))
