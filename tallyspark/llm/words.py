"""Whole texts as flat arrays of word hashes, for Arrow batches inside tasks.

A word is a maximal run of bytes other than the six ASCII white-space bytes, so words are those of the
pattern ``[^\\x20\\x09-\\x0D]+``. Texts keep their whole length; a batch is only cut between rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_tables: dict[int, np.ndarray] = {}


@dataclass
class Words:
    """Words of several texts: text r owns words ``offsets[r]`` up to ``offsets[r + 1]``."""

    hashes: np.ndarray  # uint64
    offsets: np.ndarray  # int64, one more than texts
    starts: np.ndarray  # byte positions in ``data``
    ends: np.ndarray
    data: np.ndarray  # uint8, all texts end to end
    text_offsets: np.ndarray  # int64, byte bounds of the texts in ``data``

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, in a new array."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n; kept and doubled as longer texts come."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, int(n).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _tables[base] = table
    return table[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the bounds of each; a null is an empty text."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(texts: pa.Array, word_bytes: np.ndarray = _WORD_BYTE) -> Words:
    """Words of texts: maximal runs of the bytes that ``word_bytes`` marks, never across two texts."""
    data, bounds = text_bytes(texts)
    inside = word_bytes[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        first = bounds[:-1][bounds[:-1] < len(data)]
        before[first] = False
        last = bounds[1:][bounds[1:] > 0] - 1
        after[last] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    words = Words(np.empty(0, np.uint64), np.searchsorted(starts, bounds), starts, ends, data, bounds)
    words.hashes = byte_hashes(words, starts, ends)
    return words


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their offsets by text.

    A text with fewer words has one shingle, all its words; a text without words has none.
    """
    counts = np.diff(words.offsets)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(made)))
    at = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], made)
    last = np.repeat(words.offsets[1:], made)
    padded = np.concatenate((words.hashes, np.zeros(size, np.uint64)))
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out *= _STEP
        out += padded[at + k] * (at + k < last)
    return mix(out), offsets


def byte_hashes(words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of arbitrary byte spans of the texts, white space included."""
    data = words.data
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(data) + 1)[starts])


def digests(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's word sequence; texts without words share one value."""
    n = len(words.hashes)
    place = np.arange(n) - np.repeat(words.offsets[:-1], np.diff(words.offsets))
    table = powers(int(_STEP), int(place.max()) + 1 if n else 1)[place] if n else np.empty(0, np.uint64)
    out = []
    for values in (words.hashes, mix(words.hashes + _STEP)):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * table, out=sums[1:])
        out.append(mix(sums[words.offsets[1:]] - sums[words.offsets[:-1]] + np.diff(words.offsets).astype(np.uint64)))
    return out[0], out[1]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``limit`` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each text's values; ``empty`` for a text without any."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out
