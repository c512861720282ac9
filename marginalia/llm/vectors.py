"""Vectorised byte and word primitives over Arrow batches (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
            up[0] = down[0] = 1
            _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of a binary column of about ``limit`` bytes.

    A longer single value is a piece of its own, so memory follows the longest text.
    """
    array = batch.column(column)
    if len(array) == 0:
        return
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, starts, data = array.buffers()
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(array))
        yield lo, hi, values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every whitespace-separated word, in order."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    # One separating blank after each document.
    spread = np.full(len(data) + n, 0x20, np.uint8)
    spread[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data
    solid = ~_SPACE[spread]
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _pow(len(spread) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, _U), np.cumsum((spread.astype(_U) + _U(1)) * up[: len(spread)])))
        hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
    ends = offsets[1:] + np.arange(1, n + 1)
    return np.searchsorted(ends, start, "right"), hashed


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` words by document: (hashes sorted within documents, bounds).

    A document of fewer words, but not none, has one shingle of all its words.
    """
    n = len(offsets) - 1
    doc, word = word_hashes(data, offsets)
    count = np.bincount(doc, minlength=n)
    with np.errstate(over="ignore"):
        if len(word) >= k:
            m = len(word) - k + 1
            h = np.zeros(m, _U)
            for i in range(k):
                h = h * _U(0xFF51AFD7ED558CCD) + word[i : i + m]
            inside = doc[:m] == doc[k - 1 :]
            docs, h = doc[:m][inside], h[inside]
        else:
            docs, h = np.zeros(0, np.int64), np.zeros(0, _U)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            first = np.concatenate(([0], np.cumsum(count)))
            whole = np.zeros(len(short), _U)
            for i in range(k - 1):
                has = count[short] > i
                whole[has] = whole[has] * _U(0xFF51AFD7ED558CCD) + word[first[short[has]] + i] + _U(i + 1)
            docs, h = np.concatenate((docs, short)), np.concatenate((h, whole))
    h = mix(h)
    order = np.lexsort((h, docs))
    docs, h = docs[order], h[order]
    if len(h):
        fresh = np.ones(len(h), bool)
        fresh[1:] = (docs[1:] != docs[:-1]) | (h[1:] != h[:-1])
        docs, h = docs[fresh], h[fresh]
    return h, np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=n))))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of ``key`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and keys[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        # The batch's last run may go on in the next one.
        cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)
