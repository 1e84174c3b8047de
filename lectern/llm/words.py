"""Vectorised word and shingle hashing of Arrow batches (numpy inside tasks).

A word is a maximal run of bytes other than space and \\x09-\\x0D. Words are hashed from their UTF-8 bytes with a
polynomial over random 64-bit byte values, then mixed; all hashes are 64 bits and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; bounds the numpy temporaries whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, np.bool_)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of hashes don't keep the structure of their parts."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    gap = np.ones(len(b) + 2, np.int8)
    gap[1:-1] = SPACE[b]
    turn = np.diff(gap)
    return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        top = int(ends[j - 1] - base)
        power, inverse = _grown(max(top, CHUNK_BYTES))
        total = np.zeros(top + 1, np.uint64)
        np.cumsum(BYTE_VALUE[b[base : base + top]] * power[:top], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_BASE)
        i = j
    return mix(out)


def slices(column: pa.Array, size: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, row after the last, texts joined by \\n, start of each text and the end): nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8) if len(raw) else np.zeros(1, np.int64)
    data = raw.buffers()[2]
    data = memoryview(data) if data is not None else memoryview(b"")
    i, n = 0, len(raw)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n, i + rows)
        joined = b"\n".join(data[offsets[k] : offsets[k + 1]] for k in range(i, j))
        at = offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1)
        yield i, j, joined, at
        i = j


def word_hashes(joined: bytes, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of joined texts, and for each text the index of its first word (with the end)."""
    b = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    starts, ends = spans(b)
    return span_hashes(b, starts, ends), np.searchsorted(starts, at)


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, and the index of each text's first window (with the end)."""
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    if len(words) < k:
        return np.empty(0, np.uint64), begin
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * PLACE[i]
    where = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    return mix(total[where] + np.uint64(k)), begin


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; the whole sequence is one where there are fewer words, none without words."""
    h, begin = window_hashes(words, first, k)
    out = []
    for d in range(len(first) - 1):
        if begin[d] < begin[d + 1]:
            s = np.sort(h[begin[d] : begin[d + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif first[d] < first[d + 1]:
            w = words[first[d] : first[d + 1]]
            out.append(mix((w * PLACE[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w))))
        else:
            out.append(np.empty(0, np.uint64))
    return out
