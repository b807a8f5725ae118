"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt into chunks of a few MB by a hash of their id.  A chunk sends
each distinct window hash once (with the id of the chunk's earliest document that
holds it), packed by hash bucket; a bucket finds the earliest holder of every hash
and answers each chunk with one bit per hash it sent.  The chunk then marks all
windows but the first one of each word sequence, and merges them into maximal
removal intervals.  Neither texts nor window positions travel: the shuffles carry
the texts once, about eight bytes a window, and the answers.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwatch.llm.words import U64, Words, pack, unpack, window_hashes
from threadwatch.llm.workers import begin
from threadwatch.session import ship_package

WINDOW = 20
CHUNK_BYTES = 2 << 20
#: windows that one bucket holds, about; bounds a task's memory
BUCKET_WINDOWS = 1 << 20


def _text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


class _Chunk:
    """The windows of one chunk, in document order, and which of them come first in the chunk."""

    def __init__(self, table: pa.Table, window: int):
        begin("windows")
        ids = table.column("_id").to_pylist()
        raw = table.column("_text").cast(pa.large_binary()).fill_null(b"")
        keys = [(1, i + (1 << 63)) if i is not None else (0, _text_key(raw[n].as_py())) for n, i in enumerate(ids)]
        if len(set(keys)) == len(keys):
            self.order = sorted(range(len(ids)), key=keys.__getitem__)
        else:
            self.order = sorted(range(len(ids)), key=lambda n: (keys[n], raw[n].as_py()))
        self.table = table.take(self.order)
        self.keys = [keys[n] for n in self.order]
        self.words = Words(self.table.column("_text"))
        hashes = window_hashes(self.words.hashes(), window)
        self.at = np.flatnonzero(self.words.doc[:len(hashes)] == self.words.doc[window - 1:]) if len(hashes) else \
            np.zeros(0, np.int64)
        hashes = hashes[self.at]
        by_hash = np.argsort(hashes, kind="stable")
        hashes = hashes[by_hash]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        self.hashes = hashes[new]  # distinct, ascending
        self.firsts = self.at[by_hash[new]]  # word position of the first window of each

    def buckets(self, n: int) -> np.ndarray:
        """Where each of n even hash ranges ends in ``hashes``."""
        edges = [(b << 64) // n for b in range(1, n)]
        return np.searchsorted(self.hashes, np.array(edges, U64))


def _emit(n_buckets: int, window: int):
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])

    def emit(key, table):
        chunk = _Chunk(table, window)
        ends = [0, *chunk.buckets(n_buckets).tolist(), len(chunk.hashes)]
        docs = chunk.words.doc[chunk.firsts]
        null = np.array([k[0] == 0 for k in chunk.keys], bool)
        ids = np.array([k[1] for k in chunk.keys], U64)
        rows = {"bucket": [], "chunk": [], "blob": []}
        for b in range(n_buckets):
            lo, hi = ends[b], ends[b + 1]
            if lo == hi:
                continue
            held, index = np.unique(docs[lo:hi], return_inverse=True)
            nulls = int(null[held].sum())  # they come first
            deltas = np.diff(chunk.hashes[lo:hi], prepend=U64(0))
            steps = np.diff(ids[held], prepend=U64(0))
            rows["bucket"].append(b)
            rows["chunk"].append(key[0].as_py())
            rows["blob"].append(struct.pack("<IIIQQ", hi - lo, len(held), nulls, deltas[0], steps[0])
                                + pack(deltas[1:]) + pack(index.astype(U64)) + pack(steps[1:]))
        return pa.table(rows, schema=schema)

    return emit


def _decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, held, nulls, first, id0 = struct.unpack_from("<IIIQQ", blob)
    view, at = memoryview(blob), struct.calcsize("<IIIQQ")
    deltas, at = unpack(view, at, n - 1)
    index, at = unpack(view, at, n)
    steps, at = unpack(view, at, held - 1)
    hashes = np.cumsum(np.concatenate([[U64(first)], deltas]), dtype=U64)
    ids = np.cumsum(np.concatenate([[U64(id0)], steps]), dtype=U64)
    return hashes, ids[index], index >= nulls


def _answer(key, table):
    """For each chunk's blob: a bit for every hash, set where no earlier document of another chunk has it."""
    parts = [_decode(x.as_py()) for x in table.column("blob")]
    lengths = [len(p[0]) for p in parts]
    hashes, ids, known = (np.concatenate([p[k] for p in parts]) for k in range(3))
    del parts
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(ordered), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order, ordered = order[shared], ordered[shared]
    first = np.ones(len(hashes), bool)
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        flag = known[order]  # documents without an id come first
        least_flag = np.logical_and.reduceat(flag, starts)
        rank = np.where(flag == least_flag[group], ids[order], U64(2**64 - 1))
        least = np.minimum.reduceat(rank, starts)
        first[order] = (flag == least_flag[group]) & (rank == least[group])
    rows = {"chunk": [], "bucket": [], "bits": []}
    at = 0
    for i, n in enumerate(lengths):
        part = first[at:at + n]
        at += n
        if not part.all():
            rows["chunk"].append(table.column("chunk")[i].as_py())
            rows["bucket"].append(key[0].as_py())
            rows["bits"].append(np.packbits(part).tobytes())
    return pa.table(rows, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]))


def _cut_out(text: bytes, gone: np.ndarray, start: np.ndarray) -> bytes:
    """The text without the removed words, each with the white space after it."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8)))
    place = np.append(start, len(text))[edge].tolist()
    parts = [text[a:b] for a, b in zip([0, *place[1::2]], [*place[::2], len(text)])]
    return b"".join(parts)


def _apply(n_buckets: int, window: int, schema: pa.Schema, with_spans: bool, keep_layout: bool):
    def apply(key, docs, answers):
        if docs.num_rows == 0:
            return schema.empty_table()
        chunk = _Chunk(docs, window)
        first = np.ones(len(chunk.hashes), bool)
        ends = [0, *chunk.buckets(n_buckets).tolist(), len(chunk.hashes)]
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
            n = ends[b + 1] - ends[b]
            first[ends[b]:ends[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        keep = np.zeros(len(chunk.words) + 1, bool)
        keep[chunk.firsts[first]] = True
        later = chunk.at[~keep[chunk.at]]
        change = np.zeros(len(chunk.words) + 1, np.int64)
        change[later] += 1
        np.subtract.at(change, later + window, 1)
        removed = np.cumsum(change[:-1]) > 0
        at, texts, n_removed, spans = chunk.words.first.tolist(), [], [], []
        raw = chunk.table.column("_text").cast(pa.large_binary()).to_pylist()
        for d, text in enumerate(raw):
            gone = removed[at[d]:at[d + 1]]
            n = int(gone.sum())
            n_removed.append(n)
            if not keep_layout:
                words = (text or b"").split()
                texts.append(b" ".join(compress(words, (~gone).tolist()) if n else words))
            elif not n:
                texts.append(text)
            else:
                texts.append(_cut_out(text, gone, chunk.words.start[at[d]:at[d + 1]] - chunk.words.offsets[d]))
            if with_spans:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
        columns = {"_id": chunk.table.column("_id"), "_rest": chunk.table.column("_rest"),
                   "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                   "n_words": pa.array(chunk.words.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        if with_spans:
            columns["removed"] = pa.array(spans, schema.field("removed").type)
        return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return apply


def chunk_count(texts: DataFrame, column: str, chunk_bytes: int) -> tuple[int, int]:
    """(chunks, bytes) from one aggregate over all texts."""
    total = texts.agg(F.sum(F.octet_length(column)).alias("b")).first().b or 0
    return max(1, -(-total // chunk_bytes)), total


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   carry: tuple[str, ...] = (), spans: bool = True, keep_layout: bool = False, chunk_bytes: int = CHUNK_BYTES,
                   bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Remove every word covered by a window whose word sequence starts earlier elsewhere.

    Words are maximal runs of ``[^\\x20\\x09-\\x0D]``.  Returns one row per input row:
    ``id_col``, the ``carry`` columns, ``kept_text`` (kept words joined by one space),
    ``n_words``, ``n_removed`` and, with ``spans``, ``removed`` (maximal intervals of
    word positions, end exclusive).  Earlier is: smaller id; rows without an id come
    before all others, ordered by a hash of their text; rows that share an id are ordered
    by text; of equal rows one keeps its words.  A null or empty text has no words and
    gives an empty ``kept_text``.  An empty table gives an empty result.  With ``keep_layout``
    a text without removals stays as it is (null too), and others keep their white space.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                         F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("_rest"))
    n_chunks, total = chunk_count(source, "_text", chunk_bytes)
    n_buckets = max(1, -(-total // (4 * bucket_windows)))  # at least about four bytes a word
    source = source.withColumn("_chunk", F.pmod(F.xxhash64(F.coalesce("_id", F.xxhash64("_text"))), F.lit(n_chunks)))
    sent = source.groupBy("_chunk").applyInArrow(_emit(n_buckets, window), "bucket long, chunk long, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, bits binary")
    fields = [T.StructField("_id", T.LongType()), source.schema["_rest"], T.StructField("kept_text", T.StringType()),
              T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    if spans:
        fields.append(T.StructField("removed", T.ArrayType(T.StructType(
            [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    result = source.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _apply(n_buckets, window, to_arrow_schema(schema), spans, keep_layout), schema)
    return result.select(F.col("_id").alias(id_col), *[F.col("_rest")[c].alias(c) for c in carry],
                         "kept_text", "n_words", "n_removed", *(["removed"] if spans else []))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: words kept, as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = remove_repeats(docs, spans=False)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, rowid AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)
), pos AS (
  SELECT r, doc_id, words, len(words) AS n, unnest(range(len(words) - 19)) AS p FROM w WHERE len(words) >= 20
), win AS (
  SELECT r, doc_id, p, row_number() OVER (
    PARTITION BY array_to_string(words[p + 1 : p + 20], ' ') ORDER BY doc_id, p) > 1 AS again
  FROM pos
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 20)) AS i FROM win WHERE again
), g AS (
  SELECT r, list(i) AS cut FROM gone GROUP BY r
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN cut IS NULL THEN array_to_string(words, ' ')
    ELSE coalesce(array_to_string(list_filter(words, lambda x, i : NOT list_contains(cut, i - 1)), ' '), '') END)
    AS kept_sha256
FROM w LEFT JOIN g USING (r)
"""
