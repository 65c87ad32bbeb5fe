"""Word hashes and shingle sets over whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 3
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHORT = [np.uint64(0), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte; A-Z as a-z."""
    values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[65:91] = values[97:123]
    return values


with np.errstate(over="ignore"):
    _VALUES = _byte_values()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 2)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
    return _POWERS


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and row offsets of some rows at a time, of about CHUNK_BYTES or one row."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some rows at a time: 64-bit hashes of their words in order, and row offsets into them.

    Words are runs between ASCII white space, with A-Z lower-cased. The hash is a polynomial
    over byte values modulo 2**64, taken from one prefix sum, then mixed. Null has no words.
    """
    for data, offsets in _chunks(texts):
        rows = len(offsets) - 1
        space = _SPACE[data]
        first = ~space
        first[1:] &= space[:-1]
        last = ~space
        last[:-1] &= space[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = ~space[edges]
        last[edges - 1] = ~space[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * power[: len(data)])])
            words = _mix((sums[ends] - sums[starts]) * inverse[starts])
        yield words, np.searchsorted(starts, offsets[: rows + 1])


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each row, the sorted unique 64-bit hashes of its 3-word shingles.

    A text of one or two words has its whole sequence as its one shingle; a text without words,
    like a null, has an empty set.
    """
    for words, at in word_hashes(texts):
        with np.errstate(over="ignore"):
            all3 = _mix(words[:-2] * _MULT[0] + words[1:-1] * _MULT[1] + words[2:] * _MULT[2]) if len(words) >= WIDTH else words[:0]
            for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
                n = end - start
                if n >= WIDTH:
                    s = np.sort(all3[start : end - WIDTH + 1])
                    yield s[np.concatenate([np.ones(1, bool), s[1:] != s[:-1]])]
                elif n:
                    yield _mix(np.array([_SHORT[n] + sum((words[start + k] * _MULT[k] for k in range(n)), np.uint64(0))], np.uint64))
                else:
                    yield words[:0]
