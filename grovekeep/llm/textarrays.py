"""Texts of an Arrow batch as one array of bytes, and hashes computed over it at once.

Hashes of substrings are differences of one running polynomial modulo 2^64, so a
whole batch is hashed in a few array passes whatever the lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            values = np.full(size, base, dtype=np.uint64)
            values[0] = 1
            _powers[name] = np.multiply.accumulate(values)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the offsets where each starts and the last ends."""
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text stands alone."""
    offsets = text_bytes(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends (exclusive); words never cross texts."""
    inside = IN_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def running(data: np.ndarray) -> np.ndarray:
    """The polynomial over each prefix of ``data``; one longer than ``data``."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span's content, with its length."""
    down = powers(len(total))[1]
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z in lower case, and how many words each text has."""
    starts, ends = word_spans(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    return span_hashes(running(LOWER[data]), starts, ends), np.diff(bounds)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text and how many each text has.

    A text with fewer words, but at least one, has its whole sequence as one.
    """
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * BASE)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int64)
    own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), own)
    within = np.arange(int(own.sum())) - np.repeat(np.concatenate(([0], np.cumsum(own)))[:-1], own)
    at = starts[owner] + within
    total = np.zeros(len(at), np.uint64)
    length = np.minimum(counts[owner], size)
    for i in range(size):
        has = length > i
        total[has] += words[at[has] + i] * weights[i]
    return mix(total + length.astype(np.uint64)), own
