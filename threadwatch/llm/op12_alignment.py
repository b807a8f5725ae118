"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes.  An interval is divided at a byte where a token of both
ends, found by bisection as near to its middle as there is one; both halves are divided in
turn, and an interval without such a place inside is a leaf: a group.  Tokens whose bytes
overlap are linked; links never leave a group.

Both vocabularies end a token before a space that follows another character, so texts are
divided at such spaces first.  Workers remember the groups and links of recent pieces.  Texts
are read once, in chunks of a few megabytes: a chunk stores its documents' links as counts by
the chunk's distinct id pairs, sends each pair with the number of its documents, and gets the
pair's count in the whole corpus back.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwatch.llm.pieces import _byte_letters, model_path
from threadwatch.llm.tables import stored
from threadwatch.llm.words import pack, slices_by_bytes, unpack
from threadwatch.llm.workers import begin, kept
from threadwatch.session import ship_package

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
CHUNK_BYTES = 4 << 20
#: pieces that a worker remembers, in each of two generations
REMEMBERED = 200_000
LONG_PIECE = 64
#: pieces that are encoded in one call
TOGETHER = 4096

Group = tuple[int, int, int, int]


# --- groups and links --------------------------------------------------------------------

def middle_cut(a_ends: list[int], b_ends: list[int], a0: int, a1: int, b0: int, b1: int, middle: int) -> tuple[int, int] | None:
    """The place nearest to ``middle`` where a token of both ends, inside the interval.

    Tokens a0..a1 and b0..b1 (ends exclusive) fill the interval.  Returns how many tokens
    lie before the cut: the cut ends token a-1 of the one and token b-1 of the other.
    """
    up = bisect_left(a_ends, middle, a0, a1 - 1)
    down = up - 1
    while down >= a0 or up < a1 - 1:
        if down < a0 or up < a1 - 1 and a_ends[up] - middle <= middle - a_ends[down]:
            at = up
            up += 1
        else:
            at = down
            down -= 1
        b = bisect_left(b_ends, a_ends[at], b0, b1 - 1)
        if b < b1 - 1 and b_ends[b] == a_ends[at]:
            return at + 1, b + 1
    return None


def groups_of(a_ends: list[int], b_ends: list[int]) -> list[Group]:
    """(first, end) tokens of both sides for each group, in order; the last ends must be equal."""
    out: list[Group] = []
    todo = [(0, len(a_ends), 0, len(b_ends))] if a_ends else []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        cut = None
        if a1 - a0 > 1 and b1 - b0 > 1:
            first = a_ends[a0 - 1] if a0 else 0
            cut = middle_cut(a_ends, b_ends, a0, a1, b0, b1, (first + a_ends[a1 - 1]) // 2)
        if cut is None:
            out.append((a0, a1, b0, b1))
        else:
            todo += [(cut[0], a1, cut[1], b1), (a0, cut[0], b0, cut[1])]
    return out


def links_of(a_ends: list[int], b_ends: list[int], groups: list[Group]) -> list[tuple[int, int]]:
    """Pairs of token numbers whose byte ranges overlap."""
    out = []
    for a, a1, b, b1 in groups:
        while a < a1 and b < b1:
            out.append((a, b))
            x, y = a_ends[a], b_ends[b]
            a += x <= y
            b += y <= x
    return out


# --- pieces ------------------------------------------------------------------------------

#: runs of white space that a cut at every space would divide wrongly (the text led by a space)
_RUNS = re.compile(r"  |\s (?:\s|\Z)")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
#: what a piece adds to a document's numbers: A tokens, B tokens, groups, pieces that cannot be aligned
_A, _B, _GROUPS, _LOST = 1, 1 << 32, 1 << 64, 1 << 96


class Aligner:
    """Aligned pieces, each led by a space; one per worker and pair of vocabularies."""

    _made: dict[tuple[str, str], "Aligner"] = kept({})

    @classmethod
    def of(cls, a: str, b: str) -> "Aligner":
        begin("alignment", a, b)
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(model_path(a), model_path(b))
        return cls._made[a, b]

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.n_b = self.b.get_piece_size()
        byte = {c: i for i, c in enumerate(_byte_letters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        self.space = self.b.piece_to_id("▁")
        #: no piece goes on with a space after another character, so a cut before one is a cut of B
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)
        self.a_opens = np.array([x[:1] == b" " for x in self.a_bytes])
        self.b_opens = np.array([x[:1] == b" " for x in self.b_bytes])
        self.kind = "<u4" if len(self.a_bytes) * self.n_b < 1 << 32 else "<u8"
        self.young: dict[str, tuple[bytes, str, int]] = {}
        self.old: dict[str, tuple[bytes, str, int]] = {}
        self.odd: set[str] = set()  # known pieces that are empty or have white space at an end

    def aligned(self, a: list[int], b: list[int], raw: bytes) -> tuple[bytes, str, int]:
        """(linked id pairs, groups as text, numbers) of a piece whose bytes are ``raw``."""
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return b"", "", _LOST
        a_ends, b_ends, end = [], [], 0
        for part in a_parts:
            end += len(part)
            a_ends.append(end)
        end = 0
        for part in b_parts:
            end += len(part)
            b_ends.append(end)
        groups = groups_of(a_ends, b_ends)
        pairs = np.array([a[i] * self.n_b + b[j] for i, j in links_of(a_ends, b_ends, groups)], self.kind).tobytes()
        text = ";".join([f"{','.join(map(str, a[a0:a1]))}|{','.join(map(str, b[b0:b1]))}" for a0, a1, b0, b1 in groups])
        return pairs, text, _A * len(a) + _B * len(b) + _GROUPS * len(groups)

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A of each text led by a space, and by B, which adds it."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        b = self.b.encode(texts, num_threads=1) if texts else []
        return [e.ids for e in a], [ids if t else [self.space] for t, ids in zip(texts, b)]  # B adds none to an empty text

    def _learn(self, words: list[str]) -> Iterator[tuple[str, tuple[bytes, str, int]]]:
        plain = [w for w in words if w and w == w.strip()]
        rest = [w for w in words if not w or w != w.strip()]
        for i in range(0, len(plain), TOGETHER):
            part = plain[i:i + TOGETHER]
            ids = [np.array(x[0]) for x in self._both([" ".join(part)])]
            at = [np.flatnonzero(opens[x]) for x, opens in zip(ids, (self.a_opens, self.b_opens))]
            if all(len(x) == len(part) and x[0] == 0 for x in at):  # each word's tokens open with its space
                (a, b), (a_at, b_at) = [x.tolist() for x in ids], [[*x.tolist(), len(y)] for x, y in zip(at, ids)]
                for n, w in enumerate(part):
                    yield w, self.aligned(a[a_at[n]:a_at[n + 1]], b[b_at[n]:b_at[n + 1]], b" " + w.encode())
            else:
                rest += part
        for w, a, b in zip(rest, *self._both(rest)):
            yield w, self.aligned(a, b, b" " + w.encode())

    def _know(self, words: set[str]) -> list[str]:
        """See to it that ``young`` has all ``words``; returns those too long to keep."""
        if len(self.young) > REMEMBERED:
            self.old, self.young, self.odd = self.young, {}, set()
        missing = words - self.young.keys()
        again = missing & self.old.keys()
        self.young.update((w, self.old[w]) for w in again)
        self.young.update(self._learn(list(missing - again)))
        self.odd.update(w for w in missing if not w or w != w.strip())
        return [w for w in missing if len(w) > LONG_PIECE]

    def _cut(self, text: str) -> list[str]:
        """A text's pieces, each without the space that leads it, where runs of white space must stay together."""
        first, *others = _BEFORE_SPACE.split(text) if self.cuts else [text]
        return [first, *[p[1:] for p in others]]

    def align(self, texts: list[str]) -> list[tuple[bytes, str, int]]:
        """(linked id pairs, groups as text, numbers) of each text; without tokens (b"", "", 0)."""
        cut = [(t.split(" ") if self.cuts else self._cut(t)) if t else [] for t in texts]
        words = set().union(*cut)
        passing = self._know(words)
        if not self.odd.isdisjoint(words):  # only such words make runs of white space
            cut = [self._cut(t) if t and _RUNS.search(" " + t) else c for t, c in zip(texts, cut)]
            passing += self._know(set().union(*cut))
        known = self.young
        out = []
        for pieces in cut:
            pairs, groups, numbers = zip(*map(known.__getitem__, pieces)) if pieces else ((), (), ())
            total = sum(numbers)
            out.append((b"", "", 0) if total >= _LOST else (b"".join(pairs), ";".join(groups), total))
        for w in set(passing):
            known.pop(w, None)
        return out


# --- chunks ------------------------------------------------------------------------------

CHUNK = ("chunk long, doc_ids array<long>, numbers array<long>, hashes array<string>, n_pairs long, pairs binary, "
         "n_entries long, ends binary, entries binary, times binary")
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _chunk_row(chunk: int, doc_ids: list, aligned: list[tuple[bytes, str, int]], kind: str) -> pa.RecordBatch:
    """A chunk's documents, its distinct pairs, and for each document the pairs it links and how often."""
    numbers = [[n & 0xFFFFFFFF, n >> 32 & 0xFFFFFFFF, n >> 64, len(p) // np.dtype(kind).itemsize] for p, _, n in aligned]
    codes = np.frombuffer(b"".join([p for p, _, _ in aligned]), kind).astype(np.uint64)
    doc = np.repeat(np.arange(len(aligned), dtype=np.uint64), [n[3] for n in numbers])
    pairs = np.unique(codes)
    place = np.searchsorted(pairs, codes).astype(np.uint64)
    shift = np.uint64(max(1, len(pairs)).bit_length())
    key, times = np.unique(doc << shift | place, return_counts=True)
    place = (key & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    doc = (key >> shift).astype(np.int64)
    ends = np.bincount(doc, minlength=len(aligned)) if len(key) else np.zeros(len(aligned), np.int64)
    row = {"chunk": chunk, "doc_ids": doc_ids, "numbers": [x for n in numbers for x in n],
           "hashes": [hashlib.sha256(g.encode()).hexdigest() if n else "" for _, g, n in aligned],
           "n_pairs": len(pairs),
           "pairs": pack(np.diff(pairs, prepend=np.uint64(0))) + pack(np.bincount(place, minlength=len(pairs)).astype(np.uint64)),
           "n_entries": len(key), "ends": pack(ends.astype(np.uint64)), "entries": pack(place.astype(np.uint64)),
           "times": pack(times.astype(np.uint64))}
    return pa.RecordBatch.from_pylist([row], schema=_CHUNK)


_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64())),
                    ("hashes", pa.list_(pa.string())), ("n_pairs", pa.int64()), ("pairs", pa.binary()),
                    ("n_entries", pa.int64()), ("ends", pa.binary()), ("entries", pa.binary()), ("times", pa.binary())])


def _chunks(a: str, b: str, chunk_bytes: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        doc_ids, aligned, size = [], [], 0
        for whole in batches:
            aligner = Aligner.of(a, b)
            for batch in slices_by_bytes(whole, "text", chunk_bytes // 4):
                texts = batch.column("text").to_pylist()
                doc_ids += batch.column("doc_id").to_pylist()
                aligned += aligner.align(texts)
                size += sum(len(t) for t in texts if t)
                if size >= chunk_bytes:
                    yield _chunk_row(number, doc_ids, aligned, aligner.kind)
                    number += 1
                    doc_ids, aligned, size = [], [], 0
        if doc_ids:
            yield _chunk_row(number, doc_ids, aligned, aligner.kind)

    return chunks


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, n, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n_pairs", "pairs"))):
            steps, at = unpack(memoryview(blob), 0, n)
            docs, _ = unpack(memoryview(blob), at, n)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, chunk), pa.int64()), pa.array(np.arange(n), pa.int32()),
                pa.array(np.cumsum(steps, dtype=np.uint64).astype(np.int64)), pa.array(docs.astype(np.int64))],
                names=["chunk", "place", "pair", "docs"])


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _finish(key, chunks, answers):
    parts = []
    count, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    place = answers.column("place").to_numpy()
    count[place] = answers.column("count").to_numpy()
    best[place] = answers.column("best").to_numpy()
    for row in chunks.to_pylist():
        n_docs = len(row["doc_ids"])
        per_doc, _ = unpack(memoryview(row["ends"]), 0, n_docs)
        entries, _ = unpack(memoryview(row["entries"]), 0, row["n_entries"])
        times, _ = unpack(memoryview(row["times"]), 0, row["n_entries"])
        ends = np.concatenate([[0], np.cumsum(per_doc.astype(np.int64))])
        entries, times = entries.astype(np.int64), times.astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(times * x[entries])]) for x in (best, count)]
        numbers = np.array(row["numbers"], np.int64).reshape(n_docs, len(_NUMBERS))
        parts.append(pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()),
            **{c: pa.array(numbers[:, i]) for i, c in enumerate(_NUMBERS)},
            **{c: pa.array(s[ends[1:]] - s[ends[:-1]]) for c, s in zip(("n_best", "count_sum"), sums)},
            "groups_sha256": pa.array(row["hashes"], pa.string())}))
    return pa.concat_tables(parts) if parts else _RESULT.empty_table()


_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (*_NUMBERS, "n_best", "count_sum")],
                     ("groups_sha256", pa.string())])


def align_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a: str = BYTE_VOCABULARY,
                    b: str = PIECE_VOCABULARY, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the alignment of every text's tokens by two vocabularies, and the linked id pairs.

    A text is encoded without special tokens (their strings are plain text): led by a space
    by ``a``, a byte-level vocabulary of ``tokenizers``, and as it is by ``b``, a
    ``sentencepiece`` model that adds the space.  Documents have doc_id, n_a, n_b, n_groups,
    n_links, n_best (links whose pair is its A id's most frequent one, ties included),
    count_sum (of the counts of the pairs of all links) and groups_sha256, one row per input
    row.  Pairs have a_id, b_id, count (documents that hold the pair linked) and best.

    Texts that are null, empty or not given back byte for byte by both vocabularies have no
    tokens: zeros and an empty hash.  Repeated rows are documents of their own, ids may be
    null; an empty table gives empty results.

    Texts do not travel.  A chunk's pairs go to the sums by pair with one number each; there
    are as many rows for a frequent pair as chunks, and AQE may split them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = stored(rows.mapInArrow(_chunks(a, b, chunk_bytes), CHUNK))
    sent = stored(chunks.select("chunk", "n_pairs", "pairs").mapInArrow(_pairs, "chunk long, place int, pair long, docs long"))
    n_b = _piece_count(b)
    counts = sent.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a_id", F.expr(f"pair div {n_b}"))
    most = counts.groupBy("a_id").agg(F.max("count").alias("most"))  # at most one row for each id of A
    counts = stored(counts.join(most, "a_id").select("a_id", (F.col("pair") % n_b).alias("b_id"), "pair", "count",
                                                     (F.col("count") == F.col("most")).alias("best")))
    answers = sent.join(counts.select("pair", "count", F.col("best").cast("int").alias("best")), "pair") \
        .select("chunk", "place", "count", "best")
    documents = chunks.select("chunk", "doc_ids", "numbers", "hashes", "n_entries", "ends", "entries", "times") \
        .groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish, RESULT)
    return documents, counts.drop("pair")


def _piece_count(b: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=model_path(b)).get_piece_size()


def op12_shared_cut_alignment(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: byte-level tokens against pieces, as counts and a checksum of the groups."""
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
