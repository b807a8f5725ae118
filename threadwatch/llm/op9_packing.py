"""Best-fit packing with Martello-Toth dominance reduction.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus)
reaches the driver.  There, sets of up to three pieces that provably dominate every other
set with the same largest piece are fixed as bins, in bulk, and the rest is packed best
fit, longest first.  The plan says which ranks of each length go to which bins; Spark
ranks the pieces of each length, salted, and looks the plan up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadwatch.llm.pieces import Encoder, Memory
from threadwatch.llm.tables import stored
from threadwatch.llm.words import slices_by_bytes
from threadwatch.session import ship_package

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR = 0
#: parts that the pieces of one length are ranked in
SALTS = 64
SLICE_BYTES = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Instance:
    """Counts of piece lengths, with the lengths present kept in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def largest(self, limit: int, without: tuple[int, ...] = ()) -> int | None:
        """Largest length up to ``limit`` of which a piece is left besides ``without``."""
        i = bisect_right(self.lengths, limit) - 1
        while i >= 0:
            if self.count[self.lengths[i]] > without.count(self.lengths[i]):
                return self.lengths[i]
            i -= 1
        return None

    def smallest(self, n: int, above: int = 0, without: tuple[int, ...] = ()) -> list[int]:
        """The n smallest pieces longer than ``above`` besides ``without`` (fewer if there are fewer)."""
        out: list[int] = []
        for length in self.lengths[bisect_right(self.lengths, above):]:
            out += [length] * min(n - len(out), self.count[length] - without.count(length))
            if len(out) == n:
                break
        return out

    def best_pair(self, limit: int, without: tuple[int, ...]) -> tuple[int, int] | None:
        """The two pieces with the greatest sum up to ``limit``; of equal sums the one with the longest piece."""
        best = None
        j = 0
        up = self.lengths
        for i in range(bisect_right(up, limit) - 1, -1, -1):
            a = up[i]
            if best is not None and 2 * a <= sum(best):
                break
            if self.count[a] <= without.count(a):
                continue
            while j < len(up) and up[j] + a <= limit:
                j += 1
            for k in range(min(j - 1, i), -1, -1):
                b = up[k]
                if a + b <= limit and self.count[b] > (*without, a).count(b):
                    if best is None or a + b > sum(best):
                        best = (a, b)
                    break
        return best


def dominating(inst: Instance, piece: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``piece`` that dominates every feasible set holding it, or None.

    A set dominates another if the other's pieces can be put, in groups, into places of the
    set's pieces: then some best packing has the set as a bin.
    """
    room = capacity - piece
    own = (piece,)
    one = inst.largest(room, own)
    if one is None:
        return own
    if one == room:
        return piece, one  # any other set's rest fits into this piece's place
    two = inst.smallest(2, 0, own)
    if len(two) < 2 or sum(two) > room:
        return piece, one  # nothing but a single piece can join
    three = inst.smallest(3, 0, own)
    if len(three) == 3 and sum(three) <= room:
        return None
    a, b = inst.best_pair(room, own)
    if one >= a + b:
        return piece, one
    if a == one:
        longer = inst.smallest(2, b, own)  # no pair whose shorter piece is longer than b
        if len(longer) < 2 or sum(longer) > room:
            return piece, a, b
    return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """((length, how many) of a bin, number of such bins), for pieces given as counts of lengths.

    A dominating set stays one while its copies are taken away, as the alternatives only
    get fewer; so all copies of it are fixed at once.
    """
    inst = Instance(counts)
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []
    reduced = True
    while reduced:
        reduced = False
        for j in sorted(inst.count, reverse=True):
            while inst.count.get(j):
                chosen = dominating(inst, j, capacity)
                if chosen is None:
                    break
                need = {length: chosen.count(length) for length in chosen}
                times = min(inst.count[length] // n for length, n in need.items())
                for length, n in need.items():
                    inst.take(length, times * n)
                bins.append((tuple(need.items()), times))
                reduced = True
    return bins + best_fit(inst.count, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, over groups of equal bins."""
    by_room: dict[int, list[list]] = {}  # room -> groups [contents, number of bins]
    rooms: list[int] = []

    def put(room: int, contents: tuple, n: int) -> None:
        if room not in by_room:
            by_room[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        by_room[room].append([contents, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                full, part = divmod(left, fit)
                if full:
                    put(capacity - fit * length, ((length, fit),), full)
                if part:
                    put(capacity - part * length, ((length, part),), 1)
                break
            room = rooms[i]
            contents, n = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                del rooms[i]
            fit = room // length
            full = min(n, left // fit)
            left -= full * fit
            if full:
                put(room - fit * length, (*contents, (length, fit)), full)
            if full < n and left:  # one more bin takes what is left of this length
                put(room - left * length, (*contents, (length, left)), 1)
                left = 0
                full += 1
            if full < n:
                put(room, contents, n - full)
    return [(contents, n) for groups in by_room.values() for contents, n in groups]


def runs_of(bins: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first bin, pieces a bin, offset of the first), ascending by rank."""
    at: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for contents, n in bins:
        offset = 0
        for length, k in contents:
            rank = at.get(length, 0)
            rows.setdefault(length, []).append((rank, first, k, offset))
            at[length] = rank + n * k
            offset += k * length
        first += n
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _encode(vocabulary: str, capacity: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, encoder = Memory.of("ids", vocabulary), Encoder.of(vocabulary)

        def learn(pieces):
            return {p.encode(): ids for p, ids in encoder.encode({w.decode() for w in pieces}).items()}

        for whole in batches:
            for batch in slices_by_bytes(whole, "text", SLICE_BYTES):
                out = [[] for _ in range(5)]
                cut = [t.split() for t in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
                known = memory.lookup(cut, learn)
                for doc_id, words in zip(batch.column("doc_id").to_pylist(), cut):
                    ids = b"".join(map(known.__getitem__, words)) + SEPARATOR.to_bytes(4, "little")
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start:4 * (start + capacity)]
                        for column, value in zip(out, (doc_id, piece, start, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([
                    pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return encode


def _place(plan):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                rows = order[a:b]
                n = int(length[rows[0]])
                run = runs[n]
                r = run[np.searchsorted(run[:, 0], rank[rows], "right") - 1]
                i = rank[rows] - r[:, 0]
                seq[rows] = r[:, 1] + i // r[:, 2]
                off[rows] = r[:, 3] + i % r[:, 2] * n
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(seq), pa.array(off)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                   capacity: int = CAPACITY) -> DataFrame:
    """Pack documents into as few sequences of at most ``capacity`` tokens as the method can.

    A document is its token ids by ``vocabulary`` (no added special tokens; special strings
    inside texts as the library's default) and a final id 0; only a longer one is cut.
    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the lone id 0.  Repeated rows are documents of their own; null
    ids stay null.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(source.mapInArrow(_encode(vocabulary, capacity), PIECES)
                    .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")))
    sizes = stored(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))  # at most capacity * SALTS rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(runs_of(plan_bins(counts, capacity)))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("local", local - 1).join(starts, ["length", "salt"]) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(_place(plan), PIECES + ", sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents`` in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
