"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Text bytes handled at a time.
SLICE = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix64 (fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``base``; only those that a slice of usual size needs are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        each = np.full(max(n, SLICE + 4096), base, np.uint64)
        each[0] = 1
        have = np.cumprod(each)
        if len(have) <= 3 * SLICE:
            _POWERS[base] = have
    return have


def word_hashes(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (a run of bytes other than ``between``, by default ASCII white space; A-Z lower-cased) of all texts, and the words of each text.

    A word's hash is a polynomial in its bytes, taken from one running sum over all texts, and mixed.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = between[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    first, end = edge[0::2], edge[1::2]
    values = _LOWER[data].astype(np.uint64) + np.uint64(1)
    values *= _powers(_BASE, len(data))[: len(data)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    hashed = mix((total[end] - total[first]) * _powers(_INVERSE, len(data))[first] + (end - first).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, stops)
    return hashed, np.diff(upto, prepend=0)


def combined(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k : k + n] + np.uint64(k))
    return out


def in_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of about ``most`` bytes of (id, text) batches; null texts are empty."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(i)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def word_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
    """(id, word hashes) of each row."""
    for ids, texts in in_slices(batches):
        hashed, counts = word_hashes(texts)
        at = 0
        for i, n in zip(ids, counts.tolist(), strict=True):
            yield i, hashed[at : at + n]
            at += n


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles of a word sequence; with fewer words the whole sequence is one, without words there is none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return mix(combined(words, len(words)) + np.uint64(len(words)))
    found = combined(words, width)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]
