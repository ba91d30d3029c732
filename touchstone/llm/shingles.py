"""Sets of hashed word shingles, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
LIMIT = 1 << 20
SPACES = bytes(32 if n == 32 or 9 <= n <= 13 else n for n in range(256))
_random = np.random.default_rng(7)
VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACES = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, LIMIT + (LIMIT >> 2))
        _powers[:] = [
            np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
            for base in (BASE, pow(BASE, -1, 1 << 64))
        ]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of text in which all white space is a space."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.r_[False, codes != 32, False].astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    start, stop = edges[::2], edges[1::2]
    power, inverse = powers(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum(VALUES[codes] * power[: len(data)], dtype=np.uint64)]
    return start, mixed((total[stop] - total[start]) * inverse[start])


def portions(raw: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts by about LIMIT bytes at a time; a longer one comes in parts that end between words."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for row, data in enumerate(raw):
        data = data.lower().translate(SPACES)
        while data:
            cut = len(data) if len(data) <= LIMIT else data.rfind(b" ", 0, LIMIT) + 1 or data.find(b" ") + 1 or len(data)
            rows.append(row)
            parts.append(data[:cut])
            size += cut
            data = data[cut:]
            if size >= LIMIT:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def shingle_sets(raw: list[bytes]) -> list[np.ndarray]:
    """For each text (UTF-8) the sorted distinct hashes of its shingles; of fewer words, of them all as one."""
    hashes: list[list[np.ndarray]] = [[] for _ in raw]
    for rows, parts in portions(raw):
        start, found = word_hashes(b" ".join(parts))
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        bounds = np.searchsorted(start, begins)
        for n, row in enumerate(rows):
            hashes[row].append(found[bounds[n] : bounds[n + 1]])
    sets = []
    for parts in hashes:
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if len(words) < WORDS:  # all as one, told apart from longer ones by the number of words
            whole = (words * PLACES[: len(words)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words))
            sets.append(mixed(mixed(whole))[: len(words)])
            continue
        count = len(words) - WORDS + 1
        some = sum(words[i : i + count] * PLACES[i] for i in range(WORDS))
        sets.append(np.unique(mixed(some)))
    return sets
