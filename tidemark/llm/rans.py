"""A static range asymmetric numeral system for token ids, over whole arrays of blocks.

A ``Table`` has a whole frequency for each id that occurs; they add up to a power of two.
A block is coded in ``LANES`` interleaved states (ids i, i + LANES, ... share a state) that
write 32-bit words to one stream. Every ``CHECKPOINT`` ids the states and the place in the
stream are kept, so that a block can be read from there, and all stretches between
checkpoints of all blocks at hand are decoded side by side. Each stretch must end in the
states of the next checkpoint, the last one in the states the coder began with.

Bytes of a block, little-endian: ``HEADER`` (fields below), a place (u32) for each
checkpoint, its LANES states (u64), the words (u32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

LANES = 32
CHECKPOINT = 4096
LOW = 1 << 31
#: magic, bits of a table's sum, lanes, ids, ids between checkpoints, words, CRC-32 of the ids as u32, CRC-32 of all bytes behind the header
HEADER = struct.Struct("<4sHHIIIII")
MAGIC = b"TMR1"
MAX_BITS = 24


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to the counts (all above 0), one at least, by largest remainders; their sum is a power of two."""
    n = len(counts)
    bits = min(MAX_BITS, max(12, n.bit_length() + 4))
    if n > 1 << MAX_BITS - 2:
        raise ValueError(f"more than {1 << MAX_BITS - 2} different ids")
    share = counts.astype(np.float64) / counts.sum() * ((1 << bits) - n)
    freq = 1 + np.floor(share).astype(np.int64)
    left = (1 << bits) - int(freq.sum())
    if left > 0:
        freq[np.argsort(np.floor(share) - share, kind="stable")[:left]] += 1
    elif left < 0:  # rounding of the shares
        freq[np.argmax(freq)] += left
    return freq


class Table:
    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        order = np.argsort(ids)
        self.ids, freq = ids[order].astype(np.uint32), freq[order].astype(np.uint64)
        total = int(freq.sum())
        self.bits = total.bit_length() - 1
        if total != 1 << self.bits or self.bits > MAX_BITS or (freq == 0).any():
            raise ValueError("frequencies must be above 0 and add up to a power of two")
        self.freq, self.start = freq, np.cumsum(freq) - freq
        self.of_slot = np.repeat(np.arange(len(ids), dtype=np.uint32), freq.astype(np.int64))
        self.of_id = np.full(int(self.ids[-1]) + 1, -1, np.int64)
        self.of_id[self.ids] = np.arange(len(ids))
        self.common = int(np.argmax(freq))

    def index(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and int(ids.max()) >= len(self.of_id):
            raise ValueError("an id has no frequency")
        out = self.of_id[ids]
        if (out < 0).any():
            raise ValueError("an id has no frequency")
        return out


def encode(blocks: np.ndarray, table: Table) -> list[bytes]:
    """The bytes of blocks of equal length, one in each row."""
    many, n = blocks.shape
    steps = -(-n // LANES)
    index = np.full((many, steps * LANES), table.common, np.int64)
    index[:, :n] = table.index(blocks.ravel()).reshape(many, n)
    index = np.ascontiguousarray(index.reshape(many, steps, LANES).transpose(1, 0, 2))
    freq, start = table.freq[index], table.start[index]
    limit = freq << np.uint64(63 - table.bits)
    bits, half = np.uint64(table.bits), np.uint64(32)
    words, out = np.zeros(index.shape, np.uint32), np.zeros(index.shape, bool)
    x = np.full((many, LANES), LOW, np.uint64)
    every = CHECKPOINT // LANES
    states = np.zeros((many, -(-steps // every), LANES), np.uint64)
    for s in range(steps - 1, -1, -1):
        over = x >= limit[s]
        words[s], out[s] = x.astype(np.uint32), over
        x = np.where(over, x >> half, x)
        whole = x // freq[s]
        x = (whole << bits) + (x - whole * freq[s]) + start[s]
        if s % every == 0:
            states[:, s // every] = x
    written = np.cumsum(out.sum(2), 0)  # by step and block
    result = []
    for b in range(many):
        stream = words[:, b][out[:, b]]
        at = np.concatenate([[0], written[every - 1 : steps - 1 : every, b]]).astype("<u4")
        body = at.tobytes() + states[b].astype("<u8").tobytes() + stream.astype("<u4").tobytes()
        result.append(HEADER.pack(MAGIC, table.bits, LANES, n, CHECKPOINT, len(stream), zlib.crc32(blocks[b].astype("<u4").tobytes()), zlib.crc32(body)) + body)
    return result


def decode(blocks: Sequence[bytes], table: Table, wanted: Sequence[tuple[int, int]] | None = None) -> list[np.ndarray]:
    """The ids (u32) of each block; of those in ``wanted`` only the ids from one place up to another, read from the checkpoint before."""
    heads, begins, ends, at, stop, size, streams = [], [], [], [], [], [], []
    base = 0
    for b, data in enumerate(blocks):
        magic, bits, lanes, n, every, n_words, crc, body_crc = HEADER.unpack_from(data)
        if magic != MAGIC or bits != table.bits or lanes != LANES or zlib.crc32(memoryview(data)[HEADER.size :]) != body_crc:
            raise ValueError("not a whole block of this table")
        m = -(-n // every)
        places = np.frombuffer(data, "<u4", m, HEADER.size).astype(np.int64)
        states = np.frombuffer(data, "<u8", m * LANES, HEADER.size + 4 * m).reshape(m, LANES)
        streams.append(np.frombuffer(data, "<u4", n_words, HEADER.size + 4 * m + 8 * m * LANES))
        lo, hi = wanted[b] if wanted else (0, n)
        first, last = lo // every, max(lo // every, -(-hi // every))
        heads.append((n, every, first, last, lo, hi, crc))
        begins.append(states[first:last])
        ends.append(np.vstack([states, np.full((1, LANES), LOW, np.uint64)])[first + 1 : last + 1])
        at.append(places[first:last] + base)
        stop.append(np.append(places, n_words)[first + 1 : last + 1] + base)
        size.append(np.minimum(n - np.arange(first, last) * every, every))
        base += n_words
    if not blocks:
        return []
    stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    x, at, size = np.concatenate(begins).astype(np.uint64), np.concatenate(at), np.concatenate(size)
    steps = -(-size // LANES)
    order = np.argsort(-steps, kind="stable")  # long stretches first, so that those still going on are a prefix
    x, at = x[order], at[order]
    out = np.zeros((int(steps.max(initial=0)), len(order), LANES), np.uint32)
    bits, half, low_mask, last_word = np.uint64(table.bits), np.uint64(32), np.uint64((1 << table.bits) - 1), len(stream) - 1
    going = np.searchsorted(-steps[order], -np.arange(len(out)), "left")  # stretches with more steps than s
    for s, k in enumerate(going.tolist()):
        y = x[:k]
        slot = y & low_mask
        i = table.of_slot[slot]
        out[s, :k] = i
        y = table.freq[i] * (y >> bits) + slot - table.start[i]
        low = y < LOW
        taken = np.cumsum(low, 1)
        word = stream[np.minimum(np.where(low, at[:k, None] + taken - 1, 0), last_word)]
        x[:k] = np.where(low, y << half | word, y)
        at[:k] += taken[:, -1]
    if not ((x == np.concatenate(ends)[order]).all() and (at == np.concatenate(stop)[order]).all()):
        raise ValueError("a stretch does not end at its checkpoint")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    result, k = [], 0
    for n, every, first, last, lo, hi, crc in heads:
        parts = [table.ids[out[: steps[j], back[j]].ravel()[: size[j]]] for j in range(k, k + last - first)]
        k += last - first
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if (lo, hi) == (0, n) and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of the ids differs")
        result.append(ids[lo - first * every : hi - first * every])
    return result


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, lowest power in the highest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_shifted(crc: int, n: int) -> int:
    """A part's CRC-32 as it counts in that of the whole, where n bytes follow; the whole's is the exclusive or of its parts'."""
    power, square = 1 << 31, 1 << 23  # 1 and x to the 8th
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(crc, power)
