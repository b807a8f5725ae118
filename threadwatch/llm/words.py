"""Vectorised word splitting and Rabin-Karp hashing over a batch of texts.

All functions work on the byte buffer of an Arrow string column, so one batch of
thousands of texts costs a handful of numpy passes.  Arithmetic is modulo 2**64;
every base is odd and therefore invertible, which turns a rolling hash into a
difference of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from threadwatch.llm.workers import kept

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
BLOCK_BYTES = 1 << 20

#: separators of ``[^\x20\x09-\x0D]+``
SPACE_SEPARATORS = np.zeros(256, bool)
SPACE_SEPARATORS[[0x20, 9, 10, 11, 12, 13]] = True
#: separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM_SEPARATORS = np.zeros(256, bool)
ALNUM_SEPARATORS[:0x80] = True
ALNUM_SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

SAME_CASE = np.arange(256, dtype=np.uint8)
LOWER_CASE = SAME_CASE.copy()
LOWER_CASE[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = kept({})


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        step = [np.full(size, b, U64) for b in (base, pow(base, -1, 1 << 64))]
        for s in step:
            s[0] = 1
        have = tuple(np.cumprod(s, dtype=U64) for s in step)
        if size <= 2 * BLOCK_BYTES:
            _POWERS[base] = have
    return have


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a batch: ``start``/``end`` byte positions, ``doc`` index, ``first`` word of each text."""

    def __init__(self, column, separators: np.ndarray = SPACE_SEPARATORS, fold: np.ndarray = SAME_CASE):
        self.buf, self.offsets = text_buffer(column)
        self.fold = fold
        inside = ~separators[self.buf]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word's (folded) bytes."""
        out = np.empty(len(self.start), U64)
        lut = self.fold.astype(U64) + U64(1)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + BLOCK_BYTES, "right")))
            base = int(self.start[i])
            block = lut[self.buf[base:int(self.end[j - 1])]]
            up, down = powers(BYTE_BASE, len(block) + 1)
            total = np.zeros(len(block) + 1, U64)
            np.cumsum(block * up[:len(block)], out=total[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(U64)
            i = j
        return mix(out)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive word hashes (len - width + 1 of them)."""
    if len(words) < width:
        return np.zeros(0, U64)
    out = np.empty(len(words) - width + 1, U64)
    step = BLOCK_BYTES
    for a in range(0, len(out), step):
        part = words[a:min(len(words), a + step + width - 1)]
        up, down = powers(WORD_BASE, len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[:len(part)], out=total[1:])
        n = len(part) - width + 1
        out[a:a + n] = (total[width:] - total[:n]) * down[:n]
    return mix(out)


def slices_by_bytes(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy row slices of ``batch`` whose ``column`` holds about ``limit`` bytes (a longer text stands alone)."""
    if batch.num_rows == 0:
        return
    _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def pack(values: np.ndarray) -> bytes:
    """Little-endian byte planes of unsigned values, without the planes that are zero throughout."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack(blob: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    """Inverse of ``pack``: (values, next position)."""
    width = blob[at]
    planes = np.frombuffer(blob, np.uint8, n * width, at + 1).reshape(width, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").reshape(n), at + 1 + n * width
