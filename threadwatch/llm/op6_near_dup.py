"""MinHash near-dedup with b-bit signatures.

One pass over the texts gives each document its shingle set's 128-bit key, size, band
hashes and a signature of the low four bits of every minimum, packed sixteen to a long.
Documents with the same set form a class and are never compared.  Classes that share a
band are candidates; inside a band each class is held against a pivot, never against all
others.  Bit counts of two signatures give the similarity corrected for chance collisions;
what can reach the threshold is confirmed on the full sets.  Where the classes of a band did
not all join one component, components with a plausible pair form a region, and a region's
members are compared on the full sets, block by block, across components; only links that
join components leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwatch.llm.tables import components, stored
from threadwatch.llm.words import LOWER_CASE, U64, Words, mix, slices_by_bytes, window_hashes
from threadwatch.llm.workers import begin
from threadwatch.session import ship_package

BAND_ROWS = 4
#: chance that a pair right at the threshold shares no band
MISS = 1e-9
LOW_BITS = 4
PER_LONG = 64 // LOW_BITS
#: standard errors below the threshold at which a candidate is given up
SLACK = 6.0
BLOCK = 512
BLOCK_SHINGLES = 1 << 18
#: bits of the filter that tells which texts are read again; its size does not depend on the input
FILTER_BITS = 26


def band_count(threshold: float) -> int:
    """Bands needed for ``MISS`` at ``threshold``, rounded up so that signatures fill whole longs."""
    n = math.ceil(math.log(MISS) / math.log(1 - threshold ** BAND_ROWS))
    step = PER_LONG // BAND_ROWS
    return -(-n // step) * step


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(column, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, sizes): each text's distinct shingle hashes, ascending."""
    words = Words(column, fold=LOWER_CASE)
    hashes = words.hashes()
    n = len(words.counts)
    wide = window_hashes(hashes, k)
    at = np.flatnonzero(words.doc[:len(wide)] == words.doc[k - 1:]) if len(wide) else np.zeros(0, np.int64)
    values, doc = wide[at], words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):  # the whole sequence is the one shingle; seeded by its length, so it equals no full shingle
        one = np.array([hash_sequence(hashes[words.first[d]:words.first[d + 1]]) for d in short], U64)
        values, doc = np.concatenate([values, one]), np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    sizes = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    return values, np.concatenate([[0], np.cumsum(sizes)]), sizes


def hash_sequence(words: np.ndarray) -> np.uint64:
    h = np.array([len(words)], U64)
    for w in words:
        h = mix(h * U64(0x100000001B3) ^ w)
    return h[0]


def _segment(ufunc, values: np.ndarray, offsets: np.ndarray, full: np.ndarray) -> np.ndarray:
    """ufunc over each non-empty segment."""
    return ufunc.reduceat(values, offsets[:-1][full]) if full.any() else np.zeros(0, U64)


def set_keys(values: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    full = sizes > 0
    a = _segment(np.add, mix(values ^ U64(0xA0761D6478BD642F)), offsets, full)
    b = _segment(np.add, mix(values + U64(0xE7037ED1A0B428DB)), offsets, full)
    raw = np.stack([a, b], 1).tobytes() if len(a) else b""
    out: list[bytes | None] = [None] * len(sizes)
    for i, d in enumerate(np.flatnonzero(full)):
        out[d] = raw[16 * i:16 * i + 16]
    return out


SIGNED = "row_key long, doc_id long, n_shingles long, set_key binary, sig array<long>, bands array<long>"


def _sign(k: int, bands: int):
    n_hashes = bands * BAND_ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles")
        factor = multipliers(n_hashes)
        for whole in batches:
            for batch in slices_by_bytes(whole, "text"):
                values, offsets, sizes = shingle_sets(batch.column("text"), k)
                full = sizes > 0
                least = np.empty((int(full.sum()), n_hashes), U64)
                for j in range(n_hashes):
                    least[:, j] = _segment(np.minimum, values * factor[j], offsets, full)
                low = (mix(least) & U64(2**LOW_BITS - 1)).reshape(-1, n_hashes // PER_LONG, PER_LONG)
                sig = np.bitwise_or.reduce(low << (np.arange(PER_LONG, dtype=U64) * U64(LOW_BITS)), axis=2)
                band = np.zeros((len(least), bands), U64) + np.arange(bands, dtype=U64)
                for r in range(BAND_ROWS):
                    band = mix(band * U64(0x9FB21C651E98DF25) + least[:, r::BAND_ROWS])
                yield pa.RecordBatch.from_arrays([
                    batch.column("row_key"), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                    pa.array(set_keys(values, offsets, sizes), pa.binary()),
                    _lists(sig, full), _lists(band, full)],
                    names=["row_key", "doc_id", "n_shingles", "set_key", "sig", "bands"])

    return sign


def _lists(rows: np.ndarray, full: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.where(full, rows.shape[1], 0))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.reshape(-1).view(np.int64)))


def _sets_of(k: int, wanted):
    """Shingle sets of the texts whose row key may be wanted (a filter of fixed size; an exact join follows)."""
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles")
        bits = np.frombuffer(wanted.value, np.uint8)
        for whole in batches:
            at = whole.column("bit").to_numpy(zero_copy_only=False)
            whole = whole.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for batch in slices_by_bytes(whole, "text"):
                values, offsets, sizes = shingle_sets(batch.column("text"), k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(set_keys(values, offsets, sizes), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))],
                    names=["key", "shingles"])

    return sets_of


def _bit(column):
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def _filter_of(rows: DataFrame):
    """Broadcast bitmap of ``row_key`` hashes: at most 2**FILTER_BITS / 64 words reach the driver."""
    words = rows.select(_bit("row_key").alias("bit")) \
        .groupBy(F.shiftright("bit", 6).alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")).toPandas()
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    bits[words.w.to_numpy(np.int64)] = words.v.to_numpy(np.int64)
    return rows.sparkSession.sparkContext.broadcast(bits.astype("<i8").tobytes())


def estimate(sig_a, sig_b, n_hashes: int):
    """Similarity from equal low bits, corrected for those that are equal by chance."""
    def differing(x, y):
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    unequal = F.aggregate(F.zip_with(sig_a, sig_b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0 ** -LOW_BITS
    return (1 - unequal / F.lit(float(n_hashes)) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """Components of documents whose word-shingle sets overlap by ``percent`` of their union or more.

    Texts are lower-cased (A-Z) and split into words ``[^\\x20\\x09-\\x0D]+``; with fewer
    words than ``shingle`` the whole sequence is the one shingle.  Returns one row per
    input row: doc_id, n_shingles, component_id (the smallest id in the component), kept
    (doc_id = component_id).  A null or empty text has no shingles and is linked with
    nothing: its component is its own id.  Rows without an id link like others but lend
    no id; where a component has no id at all, component_id is null and kept is true.
    Repeated rows share a component; rows of one id are all kept or all dropped when
    their texts are equal.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    threshold = percent / 100
    bands = band_count(threshold)
    n_hashes = bands * BAND_ROWS
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))).alias("row_key"),
                         F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(source.mapInArrow(_sign(shingle, bands), SIGNED))
    classes = stored(signed.filter("n_shingles > 0").groupBy(F.col("set_key").alias("key"))
                     .agg(F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"),
                          F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    members = classes.select("key", F.explode("bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stored(members.join(crowded, "band"))
    wanted = stored(shared.select("key").distinct().join(classes.select("key", "row_key", "n", "sig"), "key"))
    bits = _filter_of(wanted)
    again = source.select(_bit("row_key").alias("bit"), "text") \
        .mapInArrow(_sets_of(shingle, bits), "key binary, shingles array<long>")
    sets = stored(again.join(wanted.select("key", "n"), "key").dropDuplicates(["key"]))

    def plausible(pairs: DataFrame) -> DataFrame:
        sig = wanted.select("key", "sig")
        p = standard_error(threshold, n_hashes)
        return pairs.join(sig.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a") \
            .join(sig.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b") \
            .withColumn("est", estimate("sa", "sb", n_hashes)).filter(F.col("est") >= threshold - SLACK * p) \
            .select("a", "b", "est")

    def confirmed(pairs: DataFrame) -> DataFrame:
        common = F.size(F.array_intersect("xa", "xb")).cast("long")
        return pairs.join(sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("xa")), "a") \
            .join(sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("xb")), "b") \
            .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) \
            .withColumn("common", common) \
            .filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")

    roots, links = None, None
    for salt in (None, 1):  # every class against its most similar pivot; then other pivots where that left bands apart
        here = shared if roots is None else apart(shared, roots)
        pivot = F.min("key") if salt is None else F.min_by("key", F.xxhash64("key", F.lit(salt)))
        pivots = here.groupBy("band").agg(pivot.alias("a"))
        pairs = here.join(pivots, "band").filter("a <> key").select("a", F.col("key").alias("b")).distinct()
        best = plausible(pairs).groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a"))
        found = stored(confirmed(best.select("a", "b")))
        links = found if links is None else links.union(found)
        roots = components(links)
    families = family_edges(apart(shared, roots), wanted.select("key", "sig"), threshold, n_hashes)
    families = stored(families)
    if not families.isEmpty():
        region = components(families).select(F.col("node").alias("root"), F.col("root").alias("region"))
        members = sets.join(roots.select(F.col("node").alias("key"), "root"), "key", "left") \
            .withColumn("root", F.coalesce("root", "key")).join(region, "root")
        roots = components(links.union(links_within(members, percent)))
    grouped = signed.join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left") \
        .withColumn("root", F.coalesce("root", "set_key"))
    least = grouped.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return grouped.join(least, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")) \
        .withColumn("kept", F.when(F.col("component_id").isNull(), True)
                    .otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def standard_error(threshold: float, n_hashes: int) -> float:
    chance = 2.0 ** -LOW_BITS
    p = chance + (1 - chance) * threshold
    return math.sqrt(p * (1 - p) / n_hashes) / (1 - chance)


def apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of those bands whose classes lie in more than one component, with ``root``."""
    rooted = shared.join(roots.select(F.col("node").alias("key"), "root"), "key", "left") \
        .withColumn("root", F.coalesce("root", "key"))
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    return rooted.join(split, "band")


def dealt_pairwise(rows: DataFrame, blocks) -> DataFrame:
    """``rows`` dealt into ``blocks`` and sent to every pair (p, q) of them."""
    return rows.withColumn("x", F.pmod(F.xxhash64("key"), blocks).cast("int")) \
        .withColumn("y", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))) \
        .withColumn("p", F.least("x", "y")).withColumn("q", F.greatest("x", "y")).drop("y")


class Merging:
    """Union-find over the components met in a task."""

    def __init__(self, roots: list):
        number: dict = {}
        self.of = np.array([number.setdefault(r, len(number)) for r in roots], np.int64)

    def link(self, a: int, b: int) -> None:
        self.of[self.of == self.of[b]] = self.of[a]

    def new_links(self, i: int, others: np.ndarray) -> Iterator[int]:
        """Those of ``others`` that join another component to that of i, one for each."""
        while True:
            others = others[self.of[others] != self.of[i]]
            if not len(others):
                return
            yield int(others[0])
            self.link(i, int(others[0]))


def family_edges(rows: DataFrame, sigs: DataFrame, threshold: float, n_hashes: int) -> DataFrame:
    """(a, b): roots of components that hold a pair of one band whose estimate can reach the threshold.

    A task compares two blocks of a band, about ``BLOCK`` rows each, by bit counts, and
    returns no more than a spanning forest of the components it meets.
    """
    low = threshold - SLACK * standard_error(threshold, n_hashes)
    chance = 2.0 ** -LOW_BITS
    most = math.floor((1 - (low * (1 - chance) + chance)) * n_hashes + 1e-9)  # unequal values at most
    dealt = dealt_pairwise(rows, F.ceil(F.col("size") / BLOCK)) \
        .select("band", "p", "q", "x", "key", "root").join(sigs, "key")

    def compare(group, table):
        sig = np.array(table.column("sig").to_pylist(), np.int64).view(U64)
        root = table.column("root").to_pylist()
        merging = Merging(root)
        block = table.column("x").to_numpy()
        right = np.flatnonzero(block == group[2].as_py())
        out = []
        for i in np.flatnonzero(block == group[1].as_py()):
            others = right[merging.of[right] != merging.of[i]]
            if not len(others):
                continue
            z = sig[others] ^ sig[i]
            z |= z >> U64(2)
            z |= z >> U64(1)
            unequal = np.bitwise_count(z & U64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
            out += [(root[i], root[j]) for j in merging.new_links(i, others[unequal <= most])]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return dealt.groupBy("band", "p", "q").applyInArrow(compare, "a binary, b binary").distinct()


def links_within(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each region, by the full sets of all its members.

    ``members(region, root, key, n, shingles)``; a region's members are dealt into blocks
    of about ``BLOCK_SHINGLES`` shingles and a task compares two of them.  It returns links
    that join components, at most one fewer than the components it meets; no pairs.
    """
    sizes = members.groupBy("region").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    dealt = dealt_pairwise(members.join(sizes, "region"), F.col("blocks")) \
        .select("region", "p", "q", "x", "key", "root", "shingles")

    def compare(group, table):
        shingles = table.column("shingles").combine_chunks()
        shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
        offsets = np.asarray(shingles.offsets, np.int64)
        sizes = np.diff(offsets)
        vocabulary, ids = np.unique(np.asarray(shingles.values)[offsets[0]:offsets[-1]], return_inverse=True)
        offsets = offsets - offsets[0]
        key = table.column("key").to_pylist()
        merging = Merging(table.column("root").to_pylist())
        block = table.column("x").to_numpy()
        right = np.flatnonzero(block == group[2].as_py())
        inside = np.concatenate([ids[offsets[j]:offsets[j + 1]] for j in right]) if len(right) else ids[:0]
        starts = np.concatenate([[0], np.cumsum(sizes[right])])[:-1]
        held = np.zeros(len(vocabulary), np.uint8)
        out = []
        for i in np.flatnonzero(block == group[1].as_py()):
            if (merging.of[right] == merging.of[i]).all():
                continue
            mine = ids[offsets[i]:offsets[i + 1]]
            held[mine] = 1
            common = np.add.reduceat(held[inside], starts, dtype=np.int64)
            held[mine] = 0
            linked = right[100 * common >= percent * (sizes[i] + sizes[right] - common)]
            out += [(key[i], key[j]) for j in merging.new_links(i, linked)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return dealt.groupBy("region", "p", "q").applyInArrow(compare, "a binary, b binary")


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, 85 percent, over every whole text of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1),
      lambda i : words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, sh
"""
