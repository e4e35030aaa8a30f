"""Whole texts as NumPy arrays: UTF-8 bytes, words, word hashes and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a run of digits, letters a-z (A-Z lower-cased) and bytes from 0x80 on.
WORD_BYTE = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        WORD_BYTE[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        WORD_BYTE[_b] = _b + 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def utf8_binary(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, target: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``target`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > target:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats hashing here by far."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each document where its words start (n + 1)."""
    n_docs = len(offs) - 1
    low = WORD_BYTE[data]
    inside = low != 0
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True  # no word crosses from one document to the next
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    at = np.flatnonzero(starts)
    letters = low[inside]  # the words' bytes only, one word after the other
    first = np.flatnonzero(starts[inside])
    size = np.diff(np.append(first, len(letters)))
    within = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    terms = powers[within]
    terms *= letters
    return mix64(np.add.reduceat(terms, first)), np.searchsorted(at, offs)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document as 32-bit values, sorted, and offsets (n + 1).

    A document of fewer than k words, but not none, has one shingle of all its words.
    """
    n_docs, count = len(first) - 1, np.diff(first)
    rows, values = [], []
    total = len(hashes)
    doc = np.repeat(np.arange(n_docs), count)
    if total >= k:
        acc = np.zeros(total - k + 1, np.uint64)
        for j in range(k):
            acc = acc * _BASE + hashes[j : total - k + 1 + j]
        ok = doc[: total - k + 1] == doc[k - 1 :]
        rows.append(doc[: total - k + 1][ok])
        values.append(mix64(acc[ok]))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            acc = np.where(has, acc * _BASE + hashes[np.minimum(first[short] + j, total - 1)], acc)
        rows.append(short)
        values.append(mix64(acc + np.uint64(1)))
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(32)) | (np.concatenate(values) >> np.uint64(32))
    key = unique(key)
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(key >> np.uint64(32), np.arange(n_docs + 1, dtype=np.uint64))
