"""Occurrences of a dictionary's names in texts, and which of them hold their place.

A name of n characters can only stand where n consecutive characters of a text have its
rolling hash.  Workers hash all windows of every length that a name has; a bitmap of fixed
size tells which hashes no name has, and what passes goes to an equi-join with the names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
#: bits of the filter: 2 MB, whatever the dictionary
FILTER_BITS = 24
#: characters hashed in one go
BLOCK = 1 << 20
#: candidates that leave a worker together
ROWS = 1 << 14

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(BASE**i, BASE**-i) for i < n, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        tables = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 12), b, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def window_bits(text: str, lengths: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(length, first place, filter bit of the window at each place) for all windows of the given lengths."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    longest = max(lengths)
    for a in range(0, len(points), BLOCK):
        part = points[a:a + BLOCK + longest - 1]
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:len(part)], out=total[1:])
        for n in lengths:
            places = min(len(part) - n + 1, BLOCK)
            if places > 0:
                h = (total[n:n + places] - total[:places]) * down[:places] + np.uint64(n)
                h ^= h >> np.uint64(31)
                yield n, a, (h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - FILTER_BITS)


def _name_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [int(next(window_bits(n, [len(n)]))[2][0]) for n in batch.column("name").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], names=["bit"])


def name_filter(names: DataFrame):
    """Broadcast bitmap of the names' hashes; at most 2**FILTER_BITS / 64 words reach the driver."""
    bits = names.select("name").mapInArrow(_name_bits, "bit long")
    words = bits.groupBy(F.shiftright("bit", 6).alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")).toPandas()
    table = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    table[words.w.to_numpy(np.int64)] = words.v.to_numpy(np.int64)
    return names.sparkSession.sparkContext.broadcast(table.astype("<i8").tobytes())


def _candidates(wanted, lengths: list[int]):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(wanted.value, np.uint8)
        rows: tuple[list, list, list] = [], [], []

        def found() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.string()))],
                                             names=["key", "start", "name"])
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            a = 0
            while a < len(texts):  # texts of about a block are hashed as one; windows over their ends do not count
                before = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
                joined = "".join(texts[a:b])
                for n, first, bits in window_bits(joined, lengths):
                    held = (table[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1
                    at = np.flatnonzero(held) + first
                    own = np.searchsorted(ends, at + before, "right")
                    inside = at + before + n <= ends[own]
                    starts = np.concatenate([[0], ends])[own] - before
                    for s, i, start in zip(at[inside].tolist(), own[inside].tolist(), starts[inside].tolist()):
                        for c, v in zip(rows, (keys[i], s - start, joined[s:s + n])):
                            c.append(v)
                    if len(rows[0]) >= ROWS:
                        yield found()
                a = b
            yield found()

    return candidates


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, start, name, repl) for every place of ``texts(key, text)`` where a name of ``names(name, repl)`` stands.

    Names are compared by code point.  Work grows with the texts times the number of lengths
    that names have; the names themselves are joined, not broadcast.
    """
    lengths = sorted(r.n for r in names.select(F.char_length("name").alias("n")).distinct().collect())  # at most the longest name
    if not lengths:
        return texts.sparkSession.createDataFrame([], "key long, start long, name string, repl string")
    found = texts.mapInArrow(_candidates(name_filter(names), lengths), "key long, start long, name string")
    return found.join(names, "name").select("key", "start", "name", "repl")


def longest_first(hits: list[tuple[int, str, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping (start, name, repl), those that hold their place: longer names first, then by name, then by place."""
    starts: list[int] = []
    claims: list[tuple[int, int, str]] = []
    for start, name, repl in sorted(hits, key=lambda h: (-len(h[1]), h[1], h[0])):
        end = start + len(name)
        i = bisect_left(starts, start)
        if i < len(claims) and claims[i][0] < end or i and claims[i - 1][1] > start:
            continue
        starts.insert(i, start)
        claims.insert(i, (start, end, repl))
    return claims


def replace_claims(text: str, claims: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, repl in claims:
        out += [text[at:start], repl]
        at = end
    return "".join([*out, text[at:]])
