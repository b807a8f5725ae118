"""Hard-negative mining by Strassen products of integer tiles.

Vectors become whole numbers and are packed into blobs of a few thousand rows, each as wide
as its largest component needs.  Every block of anchors meets every block of rows; their
inner products are one matrix product, multiplied recursively by Strassen's seven products
on 64-bit integers, with zeros padding what does not halve.  A tile keeps, for each anchor,
a heap of its best rows of the same label; the heaps of all tiles merge into the anchor's
positives.  These set a window of scores each; a second round of products keeps, for each
window, a heap of the best rows of other labels, and those merge likewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwatch.llm.tables import stored
from threadwatch.session import ship_package

POSITIVES = 5
NEGATIVES = 3
#: a negative's score lies between these hundredths of its positive's score
WINDOW = (50, 95)
SCALE = 256
ANCHOR_BLOCK = 8192
ROW_BLOCK = 8192
#: rows and columns of one product
TILE = 1024
#: no side of a product is split below this
LEAF = 16


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b; by floating-point units where every partial sum is a whole number they hold exactly."""
    if a.size and b.size and a.shape[1]:
        most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
        if most < 2.0 ** 52:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, exact modulo 2**64.

    Only additions, subtractions and seven products of halves, so that sums which pass 64
    bits on the way do no harm as long as the result fits.  Odd sides get a zero row or column.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    even = [x + x % 2 for x in (m, k, n)]
    if (m, k) != (even[0], even[1]):
        a = np.pad(a, ((0, even[0] - m), (0, even[1] - k)))
    if (k, n) != (even[1], even[2]):
        b = np.pad(b, ((0, even[1] - k), (0, even[2] - n)))
    h, i, j = (x // 2 for x in even)
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    out = np.empty((even[0], even[2]), np.int64)
    c11, c12, c21, c22 = out[:h, :j], out[:h, j:], out[h:, :j], out[h:, j:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:] = p
    c22[:] = p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


def _pack(table: pa.Table, dim: int) -> dict:
    """ids, labels and components of rows as bytes, ascending by id; components as narrow as they can be."""
    order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
    flat = table.column("ints").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    x = np.asarray(flat.flatten(), np.int64).reshape(-1, dim)[order]
    most = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return {"n": len(x), "width": width, "ids": table.column("vec_id").to_numpy()[order].astype("<i8").tobytes(),
            "labels": table.column("label").to_numpy()[order].astype("<i8").tobytes(),
            "keys": table.column("key").to_numpy()[order].astype("<i8").tobytes(),
            "cells": x.astype(f"<i{width}").tobytes()}


BLOB = "n long, width int, ids binary, labels binary, keys binary, cells binary"
_BLOB = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()),
                   ("labels", pa.binary()), ("keys", pa.binary()), ("cells", pa.binary())])


def _blob(key, table):
    dim, part = key[0].as_py(), key[1].as_py()
    return pa.Table.from_pylist([{"dim": dim, "part": part, **_pack(table, dim)}], schema=_BLOB)


class _Rows:
    """One blob, read back."""

    def __init__(self, table: pa.Table, dim: int):
        row = table.to_pylist()[0]
        self.ids, self.labels, self.keys = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "keys"))
        self.cells = np.frombuffer(row["cells"], f"<i{row['width']}").reshape(-1, dim).astype(np.int64)


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of the places ``at`` (ascending by id) with the greatest scores; ties to the earlier place."""
    if len(at) > k:
        held = score[at]
        at = at[held >= np.partition(held, len(at) - k)[len(at) - k]]
    return at[np.argsort(-score[at], kind="stable")[:k]]


def _tiles(dim: int, asked: pa.Table, held: pa.Table):
    """(anchors, rows, first anchor, first row, scores) of every tile of two blobs."""
    if not (asked.num_rows and held.num_rows):
        return
    anchors, rows = _Rows(asked, dim), _Rows(held, dim)
    for c in range(0, len(rows.ids), TILE):
        turned = np.ascontiguousarray(rows.cells[c:c + TILE].T)
        for r in range(0, len(anchors.ids), TILE):
            yield anchors, rows, r, c, strassen(anchors.cells[r:r + TILE], turned)


class _Heaps:
    """What the heaps of a pair of blocks hold: one row for each place, with the values that its heap goes by."""

    def __init__(self, *names: str):
        self.names = (*names, "vec_id", "vec_key", "score")
        self.columns: list[list[np.ndarray]] = [[] for _ in self.names]

    def add(self, values: tuple, best: np.ndarray, ids: np.ndarray, keys: np.ndarray, score: np.ndarray) -> None:
        for column, part in zip(self.columns, (*[np.full(len(best), v, np.int64) for v in values],
                                               ids[best], keys[best], score[best])):
            column.append(part)

    def table(self) -> pa.Table:
        return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64())
                         for n, c in zip(self.names, self.columns)})


FOUND = "vec_id long, vec_key long, score long"


def _positives(k: int):
    def positives(key, asked, held):
        heaps = _Heaps("part", "anchor_id", "key")
        for anchors, rows, r, c, scores in _tiles(key[0].as_py(), asked, held):
            ids, labels, keys = (x[c:c + TILE] for x in (rows.ids, rows.labels, rows.keys))
            for i, score in enumerate(scores, r):
                same = np.flatnonzero((labels == anchors.labels[i]) & (ids != anchors.ids[i]))
                heaps.add((key[1].as_py(), anchors.ids[i], anchors.keys[i]), _best(score, same, k), ids, keys, score)
        return heaps.table()

    return positives


def _negatives(k: int):
    def negatives(key, asked, held):
        heaps = _Heaps("anchor_id", "key", "low", "high")
        windows: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for w in asked.column("windows")[0].as_py() if asked.num_rows and held.num_rows else ():
            windows.setdefault((w["anchor_id"], w["key"]), set()).add((w["low"], w["high"]))
        for anchors, rows, r, c, scores in _tiles(key[0].as_py(), asked, held):
            ids, labels, keys = (x[c:c + TILE] for x in (rows.ids, rows.labels, rows.keys))
            for i, score in enumerate(scores, r):
                anchor = int(anchors.ids[i]), int(anchors.keys[i])
                if anchor not in windows:
                    continue
                other = np.flatnonzero((labels != anchors.labels[i]) & (ids != anchors.ids[i]))
                found = score[other]
                for low, high in windows[anchor]:
                    inside = other[(found >= low) & (found <= high)]
                    heaps.add((*anchor, low, high), _best(score, inside, k), ids, keys, score)
        return heaps.table()

    return negatives


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, ints, dim, key) of the rows that take part; equal rows once."""
    limit = float(1 << 62)
    real = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec")) \
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()) \
        .filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) \
        .filter(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.lit(float(scale)) * F.abs(x) + 1, F.lit(2.0))) < limit)
    cells = F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    return real.select("vec_id", "label", cells.alias("ints")).withColumn("dim", F.size("ints")) \
        .filter("dim > 0").dropDuplicates(["vec_id", "label", "ints"]).withColumn("key", F.xxhash64("label", "ints"))


def mine(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
         is_anchor: Column | None = None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW, scale: int = SCALE, anchor_block: int = ANCHOR_BLOCK,
         row_block: int = ROW_BLOCK) -> DataFrame:
    """Hard negatives of every anchor and positive: rows of another label whose score is close below the positive's.

    A component x becomes floor(scale * x); a score is the integer inner product with the
    anchor.  An anchor's positives are its ``n_positives`` best rows of its label; for each,
    the ``n_negatives`` best rows of other labels with ``window[0] * positive <= 100 *
    negative <= window[1] * positive`` are returned: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.  Ties go to the smaller id; where there are
    fewer rows, all are taken.  ``is_anchor`` is a condition on ``vec_id``.

    Rows with a null id, label or vector, a null or non-finite component, or no component
    take no part, nor do rows so long that a score might not fit 64 bits.  Equal rows count
    once; an id with several vectors or labels is several rows, none of them a partner of
    another.  Vectors meet those of the same dimension only.  An empty table gives nothing.

    Blocks are dealt by a hash of the row, so a label, source or repeated vector that holds
    a third of all rows spreads like any other; every task holds two blocks.  The anchors
    are a stated query set: each block of them meets each block of rows.
    """
    ship_package(vectors.sparkSession)
    label = F.col("label") if label is None else label
    is_anchor = F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor
    rows = usable(vectors, id_col, vec_col, label, scale)
    rows = stored(rows.withColumn("anchor", F.coalesce(is_anchor, F.lit(False))))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")) \
        .agg(F.max("n").alias("n"), F.max("a").alias("a")).first()
    row_blocks, anchor_blocks = max(1, -(-(sizes.n or 0) // row_block)), max(1, -(-(sizes.a or 0) // anchor_block))

    def blobs(part: DataFrame, blocks: int, name: str) -> DataFrame:
        dealt = part.withColumn("part", F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).cast("long"))
        return stored(dealt.groupBy("dim", "part").applyInArrow(_blob, f"dim int, part long, {BLOB}")
                      .withColumnRenamed("part", name))

    def parts(k: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))

    # a pair of blocks is a group of its own, dealt by both numbers
    by = ["dim", "anchors", "rows"]
    held = blobs(rows, row_blocks, "rows").withColumn("anchors", parts(anchor_blocks))
    asked = blobs(rows.filter("anchor"), anchor_blocks, "anchors")

    def products(anchors: DataFrame, function, schema: str) -> DataFrame:
        anchors = anchors.withColumn("rows", parts(row_blocks))
        return anchors.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(function, schema)

    def merged(heaps: DataFrame, k: int, *keys: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "vec_key"))
        return heaps.withColumn("rank", place).filter(F.col("rank") <= k)

    found = products(asked, _positives(n_positives), f"part long, anchor_id long, key long, {FOUND}")
    hundredths = [F.lit(w).cast("decimal(9,0)") * F.col("score").cast("decimal(19,0)") / 100 for w in window]
    positives = stored(merged(found, n_positives, "anchor_id", "key").withColumn("low", F.ceil(hundredths[0]).cast("long"))
                       .withColumn("high", F.floor(hundredths[1]).cast("long")))
    windows = positives.filter("low <= high").groupBy(F.col("part").alias("anchors")) \
        .agg(F.collect_set(F.struct("anchor_id", "key", "low", "high")).alias("windows"))  # a block's anchors at most
    near = products(asked.join(windows, "anchors"), _negatives(n_negatives),
                    f"anchor_id long, key long, low long, high long, {FOUND}")
    negatives = merged(near, n_negatives, "anchor_id", "key", "low", "high")
    return positives.select("anchor_id", "key", "low", "high", F.col("vec_id").alias("positive_id"),
                            F.col("score").alias("positive_score")) \
        .join(negatives, ["anchor_id", "key", "low", "high"]) \
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))


def op13_strassen_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Rows of ``embeddings`` whose id is divisible by 50 as anchors against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, label=label)


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x : x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
