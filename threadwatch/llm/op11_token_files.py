"""Token ids in files of directly addressable codes.

Documents are dealt to ranges of ids and encoded there in order.  A file holds the ids of
some consecutive documents, split into chunks of eight bits: level 0 has the lowest chunk of
every id, level 1 the next chunk of those ids that have one, and so on.  A bitmap beside each
level tells which chunks go on in the next level, and a directory of bit counts gives the
rank of any place in the bitmap: so any id, or the ids of any document, are read by a few
look-ups, and nothing before them is decoded.

Files are plain bytes (one row of Spark's text writer each, hence one line feed at the end)
and are read with Spark's ``binaryFile`` source, so that any store Spark knows will do.  A
manifest, a small Parquet table, says which ids of the whole corpus each file holds.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadwatch.llm.pieces import _CUT, _PLAIN, Encoder, _packed, model_path
from threadwatch.llm.tables import stored
from threadwatch.llm.words import slices_by_bytes
from threadwatch.llm.workers import begin, kept
from threadwatch.session import ensure_checkpoint_dir, ship_package, small_arrow_batches

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: ids after which a file ends, at the end of a document
FILE_IDS = 1 << 22
#: bytes of text in a range of documents, about
RANGE_BYTES = 32 << 20
SLICE_BYTES = 2 << 20
#: ids that are read back at once, about
READ_IDS = 1 << 18
#: words that a worker remembers, in each of two generations
REMEMBERED = 200_000
#: parts of words that a worker remembers
PARTS = 50_000
LONG_WORD = 64
LONG_TEXT = 1 << 16

MAGIC = b"THRWTOK1"
#: magic, ids, documents, levels, range, number within the range
HEADER = struct.Struct("<8sQQQQQ")
BLOCK_BITS = 512


# --- the codes ---------------------------------------------------------------------------

def _bitmap(flags: np.ndarray) -> np.ndarray:
    words = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    words[:len(packed)] = packed
    return words.view("<u8")


def _directory(words: np.ndarray) -> np.ndarray:
    """Ones before each block of ``BLOCK_BITS`` bits."""
    per = BLOCK_BITS // 64
    ones = np.bitwise_count(np.pad(words, (0, -len(words) % per))).reshape(-1, per).sum(axis=1, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])


def encode_levels(ids: np.ndarray) -> list[bytes]:
    """The levels of an array of ids: chunk count, chunks and, but for the last level, bitmap and rank directory."""
    out = []
    rest = ids.astype(np.uint32, copy=False)
    while True:
        goes_on = rest > 255
        last = not goes_on.any()
        part = struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes()
        part += b"\0" * (-len(part) % 8)
        if not last:
            words = _bitmap(goes_on)
            part += words.tobytes() + _directory(words).astype("<u8").tobytes()
        out.append(part)
        if last:
            return out
        rest = rest[goes_on] >> np.uint32(8)


class TokenFile:
    """Random access to the ids of one file's bytes."""

    def __init__(self, content: bytes):
        magic, self.n_ids, self.n_docs, n_levels, self.range, self.number = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = HEADER.size
        self.doc_ids = np.frombuffer(content, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(content, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.known = np.unpackbits(np.frombuffer(content, np.uint8, -(-self.n_docs // 8), at), count=self.n_docs,
                                   bitorder="little").astype(bool)
        at += -(-self.n_docs // 64) * 8
        self.levels = []
        for level in range(n_levels):
            n, = struct.unpack_from("<Q", content, at)
            chunks = np.frombuffer(content, np.uint8, n, at + 8)
            at += -(-(8 + n) // 8) * 8
            words = directory = None
            if level < n_levels - 1:
                words = np.frombuffer(content, "<u8", -(-n // 64), at)
                at += 8 * len(words)
                directory = np.frombuffer(content, "<u8", -(-n // BLOCK_BITS) + 1, at)
                at += 8 * len(directory)
            self.levels.append((chunks, words, directory))

    def __len__(self) -> int:
        return self.n_ids

    @staticmethod
    def _rank(words: np.ndarray, directory: np.ndarray, place: int) -> int:
        """Ones before ``place``."""
        block, word = place // BLOCK_BITS, place // 64
        ones = int(directory[block])
        ones += int(np.bitwise_count(words[block * (BLOCK_BITS // 64):word]).sum())
        if place % 64:
            ones += (int(words[word]) & ((1 << place % 64) - 1)).bit_count()
        return ones

    def __getitem__(self, place: int) -> int:
        """The id at one place: one chunk, one bit and one rank a level."""
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        value = shift = 0
        for chunks, words, directory in self.levels:
            value |= int(chunks[place]) << shift
            if words is None or not int(words[place // 64]) >> place % 64 & 1:
                break
            place = self._rank(words, directory, place)
            shift += 8
        return value

    def between(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``, as unsigned 32-bit numbers."""
        out = np.zeros(end - start, "<u4")
        at = np.arange(end - start)
        for level, (chunks, words, directory) in enumerate(self.levels):
            out[at] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            if words is None or start == end:
                break
            first = start // 64
            bits = np.unpackbits(words[first:-(-end // 64)].view(np.uint8), bitorder="little")[start - 64 * first:end - 64 * first]
            at = at[bits.astype(bool)]
            start = self._rank(words, directory, start)
            end = start + len(at)
        return out

    def document(self, n: int) -> np.ndarray:
        return self.between(int(self.starts[n]), int(self.starts[n + 1]))


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, part: int, number: int) -> bytes:
    """One file: header, ids of documents, their starts, which have an id, levels."""
    levels = encode_levels(ids)
    known = np.array([i is not None for i in doc_ids], bool)
    return b"".join([
        HEADER.pack(MAGIC, len(ids), len(doc_ids), len(levels), part, number),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        np.concatenate([[0], np.cumsum(np.array(lengths, np.uint64))]).astype("<u8").tobytes(),
        _bitmap(known).tobytes(), *levels])


# --- the ids -----------------------------------------------------------------------------

#: white space before which no byte-level token of the text before it goes on
_SAFE = re.compile(r"(?<=\S)(?=\s)")
#: where runs of white space do not end with the one space that leads the next word
_RUNS = re.compile(r"\s \s|\s \Z")


class _Known(dict):
    """Ids by word; a word that is not there is learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        return self.learn(word)


class WordIds:
    """Packed ids of words as they stand after a space; one per worker and vocabulary.

    Texts are cut at spaces.  Letters not seen lately, with marks or not, go straight to the
    library's model; any other new word is cut further before other white space and its
    pieces go to the library.  Two plain words around a line feed are taken apart.
    """

    _made: dict[str, "WordIds"] = kept({})

    @classmethod
    def of(cls, name: str) -> "WordIds":
        begin("word ids", name)
        if name not in cls._made:
            cls._made[name] = cls(model_path(name))
        return cls._made[name]

    def __init__(self, path: str):
        self.pieces = Encoder(path)
        #: whether tokens end before a space that follows another character
        self.cuts = self.pieces.byte_level
        self.special = [t.content for t in self.pieces.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.pieces.model.tokenize
        self.young = _Known(self._learn)
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()  # known words that are empty or have white space at an end
        self.passing: list[str] = []  # odd words of the text at hand that are too long to keep

    def _library(self, text: str) -> bytes:
        return np.array(self.pieces.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        """A text without special strings, cut before white space that follows other characters."""
        parts = _CUT.split(text)
        found = self.pieces.encode(set(parts))
        if len(self.pieces.parts) > PARTS:
            self.pieces.parts.clear()
        return b"".join(map(found.__getitem__, parts))

    def _letters(self, word: str) -> bytes:
        return _packed([t.id for t in self.tokenize("Ġ" + word if word.isascii() else self.pieces._shown(" " + word))])

    def _plain(self, word: str) -> bytes | None:
        """A word of letters, then marks: the model's tokens of either, those of known letters as they are; None for another."""
        m = _PLAIN.fullmatch(word)
        if m is None or m[1]:
            return None
        ids = self.young.get(m[2]) or self.old.get(m[2]) or self._letters(m[2])
        return ids + self.pieces._part(m[3]) if m[3] else ids

    def _two_lines(self, word: str) -> bytes | None:
        """A plain or known word, a line feed and a plain word; None for another."""
        line, _, rest = word.partition("\n")
        if not rest or not line or line != line.strip():
            return None
        ids = self.young.get(line) or self.old.get(line) or self._plain(line)
        more = self.pieces._direct("\n" + rest) if ids else None
        if len(self.pieces.parts) > PARTS:
            self.pieces.parts.clear()
        return ids + more if more else None

    def _learn(self, word: str) -> bytes:
        ids = self.old.get(word)
        keep = len(word) <= LONG_WORD
        if ids is None:
            if keep:
                ids = self._letters(word) if word.isascii() and word.isalpha() else self._plain(word)
                if ids is not None:
                    self.young[word] = ids
                    return ids
                ids = self._two_lines(word)
                if ids is not None:  # not kept: the same lines seldom meet again
                    return ids
            ids = self._ids(" " + word)
        if keep:
            self.young[word] = ids
        if not word or word != word.strip():
            self.odd.add(word)
            if not keep:
                self.passing.append(word)
        return ids

    def _whole(self, text: str) -> bytes:
        """A text that is not cut at its spaces, in parts of some length that end before white space."""
        if not self.cuts:
            return self._library(text)
        out, at = [], 0
        while at < len(text):
            m = _SAFE.search(text, at + LONG_TEXT)
            end = m.end() if m else len(text)
            out.append(self._library(text[at:end]))
            at = end
        return b"".join(out)

    def _one(self, text: str) -> bytes:
        if not text or not self.cuts or any(s in text for s in self.special):
            return self._whole(text)
        if len(self.young) > REMEMBERED:
            self.old, self.young, self.odd = dict(self.young), _Known(self._learn), set()
        words = text.split(" ")
        ids = b"".join([self._ids(words[0]), *map(self.young.__getitem__, words[1:])])
        # only odd words make runs of white space
        if self.odd and not self.odd.isdisjoint(words) and _RUNS.search(text):
            ids = self._whole(text)
        if self.passing:
            self.odd.difference_update(self.passing)
            self.passing.clear()
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit numbers."""
        return [self._one(t) for t in texts]


def _files(vocabulary: str, file_ids: int):
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        end = END_ID.to_bytes(4, "little")
        doc_ids, lengths, held, size = [], [], bytearray(), 0

        def made():
            content = file_bytes(doc_ids, lengths, np.frombuffer(held, "<u4"), part, number)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for whole in batches:
            encoder = WordIds.of(vocabulary)
            for batch in slices_by_bytes(whole, "text", SLICE_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                    doc_ids.append(doc_id)
                    lengths.append(len(ids) // 4 + 1)
                    held += ids + end
                    size += lengths[-1]
                    if size >= file_ids:
                        yield made()
                        number += 1
                        doc_ids, lengths, held, size = [], [], bytearray(), 0
        if doc_ids:
            yield made()

    return files


MANIFEST = "path string, range long, number long, start long, n_ids long, n_docs long"


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str = VOCABULARY, file_ids: int = FILE_IDS, range_bytes: int = RANGE_BYTES) -> None:
    """Write the ids of all texts under ``path``: ``files/`` and ``manifest/``.

    Each text is encoded as ``tokenizers`` does by ``vocabulary``, without added special
    tokens (special strings inside texts as its default), and ends with id 0.  Documents
    stand in ascending order of ``id_col``; those without an id come first, and rows that
    share an id are ordered by a hash of their text.  A null or empty text is the lone id 0;
    repeated rows are documents of their own.  An empty table gives no file.

    Ranges of ids are cut by Spark's sample of the ids, and by the text and the
    place of a row as well, so no id and no repeated row holds a range together; a range's
    rows are sorted (spilling if need be) and pass through one task as a stream.  Texts are
    shuffled once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc(), F.col("place").asc()]
    ordered = rows.withColumn("place", F.monotonically_increasing_id()) \
        .repartitionByRange(max(1, -(-total // range_bytes)), *order).sortWithinPartitions(*order)
    content = ordered.select("doc_id", "text").mapInArrow(_files(vocabulary, file_ids), "content binary")
    with small_arrow_batches(spark):
        content.select(F.col("content").cast("string").alias("value")) \
            .write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{path}/files")

    heads = spark.read.format("binaryFile").load(f"{path}/files").filter("length > 1") \
        .select("path", F.expr(f"substring(content, 1, {HEADER.size})").alias("content"))
    heads = heads.select("path", *[_unsigned(8 * i).alias(c) for i, c in
                                   ((4, "range"), (5, "number"), (1, "n_ids"), (2, "n_docs"))])

    def before(*order):
        return F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)),
                          F.lit(0))

    # where a file starts: the ranges before, in blocks so that no window holds them all, then the files before in its range
    ranges = heads.groupBy("range").agg(F.sum("n_ids").alias("n")).withColumn("g", F.shiftright("range", 10))
    blocks = ranges.groupBy(F.col("g").alias("block")).agg(F.sum("n").alias("n")).withColumn("g", F.lit(0)) \
        .select(F.col("block").alias("g"), before("block").alias("block_start"))
    starts = ranges.withColumn("in_block", before("range")).join(blocks, "g") \
        .select("range", (F.col("block_start") + F.col("in_block")).alias("range_start"))
    files = heads.withColumn("n", F.col("n_ids")).withColumn("g", F.col("range")).withColumn("in_range", before("number"))
    files.join(starts, "range") \
        .select("path", "range", "number", (F.col("range_start") + F.col("in_range")).alias("start"), "n_ids", "n_docs") \
        .write.parquet(f"{path}/manifest")


def _unsigned(at: int):
    """A number of eight bytes, lowest first, at a place of ``content``."""
    number = F.lit(0).cast("long")
    for i in range(8):
        byte = F.conv(F.hex(F.expr(f"substring(content, {at + i + 1}, 1)")), 16, 10).cast("long")
        number = number + F.shiftleft(byte, 8 * i)
    return number


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            f = TokenFile(content.as_buffer())
            crc, done = [], 0
            while done < f.n_docs:  # some documents at a time: decoding takes several times the room of their ids
                upto = max(done + 1, int(np.searchsorted(f.starts, f.starts[done] + READ_IDS, "right")) - 1)
                edges = f.starts[done:upto + 1]
                ids = memoryview(f.between(int(edges[0]), int(edges[-1])).tobytes())
                edges = (4 * (edges - edges[0])).tolist()
                crc += [zlib.crc32(ids[i:j]) for i, j in zip(edges, edges[1:])]
                done = upto
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(f.n_docs, f.range), pa.int64()), pa.array(np.full(f.n_docs, f.number), pa.int64()),
                pa.array(f.doc_ids, mask=~f.known), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)),
                pa.array(crc, pa.int64())], names=["range", "number", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of ``write_token_files``.

    ``start`` counts the ids of all documents before it; the checksum covers the ids, read
    back, as little-endian unsigned 32-bit numbers.
    """
    ship_package(spark)
    content = spark.read.format("binaryFile").load(f"{path}/files").filter("length > 1").select("content")
    found = content.mapInArrow(_documents, "range long, number long, doc_id long, at long, n_tokens long, ids_crc32 long")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("range", "number", "start")
    return found.join(manifest, ["range", "number"]) \
        .select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = batch.column("places").to_pylist()
        for content, asked in zip(batch.column("content"), places):
            f = TokenFile(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([a["place"] for a in asked], pa.int64()),
                                              pa.array([f[a["at"]] for a in asked], pa.int64())], names=["place", "id"])


def tokens_at(spark, path: str, places: DataFrame) -> DataFrame:
    """(place, id) for each ``place`` of the whole corpus; places beyond its ends give no row.

    A place is looked up in its own file, without decoding what stands before it.
    """
    ship_package(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # files by slots of the ids, so that the search is an equi-join
    slots = manifest.withColumn("slot", F.explode(F.sequence(
        F.expr(f"start div {FILE_IDS}"), F.expr(f"(start + n_ids - 1) div {FILE_IDS}"))))
    asked = places.select(F.col("place").cast("long").alias("place")).filter("place >= 0").distinct()
    hit = asked.withColumn("slot", F.expr(f"place div {FILE_IDS}")).join(slots, "slot") \
        .filter("place >= start and place < start + n_ids")
    by_file = hit.groupBy("path").agg(F.collect_list(F.struct("place", (F.col("place") - F.col("start")).alias("at"))).alias("places"))
    content = spark.read.format("binaryFile").load(f"{path}/files").select("path", "content")
    return by_file.join(content, "path").select("places", "content").mapInArrow(_at, "place long, id long")


def op11_direct_token_files(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` written as token files and read back, as checksums."""
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    with small_arrow_batches(spark):  # a file at a time goes to Python
        return stored(read_documents(spark, path))
