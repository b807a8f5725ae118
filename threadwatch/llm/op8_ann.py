"""Nearest neighbours by randomly rotated one-bit codes.

The index holds, for every vector, the signs of its rotated, centred and normalised form
as packed bits with two correction scalars: the length of the centred vector and the
inner product of the code with what it stands for.  A query's rotated coordinates are
quantised to a few bits and split into bit planes, so its inner product with a code is a
sum of bit counts.  Error bounds of that estimate say which vectors may be among the
nearest; only those are ranked by their exact inner product.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadwatch.llm.tables import stored
from threadwatch.session import ship_package

SEED = 20
#: rows that the centre is fitted on, those with the smallest hash of their id
CENTRE_SAMPLE = 4096
#: standard errors of the estimate that the bounds allow for
SIGMAS = 3.0
QUERY_BITS = 6
QUERY_BLOCK = 8192
SLICE_ROWS = 65536
MIN_SLICES = 12


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def pack_bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(signs, axis=1, bitorder="little")
    words = -(-signs.shape[1] // 64)
    wide = np.zeros((len(signs), words * 8), np.uint8)
    wide[:, :packed.shape[1]] = packed
    return wide.view("<u8")


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, length of the centred vector, inner product of code and direction)."""
    rest = vectors - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    turned = (rest / np.maximum(length, 1e-300)[:, None]) @ rotation(vectors.shape[1]).T
    return pack_bits(turned > 0), length, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def estimates(queries: np.ndarray, centre: np.ndarray, codes: np.ndarray, length: np.ndarray, match: np.ndarray,
              sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, their error bounds), queries by codes."""
    dim = queries.shape[1]
    turned = queries @ rotation(dim).T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    weighted = np.zeros((len(queries), len(codes)), np.int64)
    for bit in range(QUERY_BITS):
        plane = pack_bits(level >> bit & 1 == 1)
        for w in range(codes.shape[1]):
            weighted += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int64) << bit
    positive = low[:, None] * ones[None, :] + step[:, None] * weighted
    whole = (low * dim + step * level.sum(axis=1))[:, None]
    code_product = (2 * positive - whole) / np.sqrt(dim)
    match = np.maximum(match, 1e-12)
    value = (queries @ centre)[:, None] + length[None, :] * code_product / match[None, :]
    norm = np.sqrt((queries * queries).sum(axis=1))
    spread = np.sqrt(np.maximum(1 - match * match, 0)) / match / np.sqrt(max(dim - 1, 1))
    rounding = step * np.sqrt(dim) / 2
    bound = length[None, :] * (sigmas * norm[:, None] * spread[None, :] + rounding[:, None] / match[None, :])
    return value, bound


def _matrix(column, dim: int, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return np.asarray(column.flatten(), kind).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, dim) of rows with an id and a finite, non-zero vector; equal rows once."""
    vec = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")) \
        .filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()) \
        .filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) \
        .filter(F.exists("vec", lambda x: x != 0)) \
        .withColumn("dim", F.size("vec")).dropDuplicates(["vec_id", "vec"])


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", is_query=None, k: int = 20,
            sigmas: float = SIGMAS) -> DataFrame:
    """The ``k`` rows of greatest inner product with each query row, by exact double-precision product.

    Queries are the rows that ``is_query`` (a condition on ``vec_id``; default: divisible
    by 20) selects; candidates are all rows of the same dimension but those with the
    query's id.  Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id.  Vectors that are null, zero or hold a null or non-finite component, and rows
    without an id, take no part.  Equal rows count once; an id with several vectors is
    several rows.  Fewer candidates than ``k`` give all; an empty table gives nothing.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, id_col, vec_col)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_SAMPLE)
    means = sample.select("dim", F.posexplode("vec").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("x"))
    centres: dict[int, np.ndarray] = {}
    for r in means.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).collect():
        centres[r["dim"]] = np.array([c["x"] for c in r["c"]])  # one centre for each dimension of the sample
    shared = spark.sparkContext.broadcast(centres)

    def index(key, table):
        dim = key[0].as_py()
        x = _matrix(table.column("vec"), dim, np.float64)
        codes, length, match = encode(x, shared.value.get(dim, np.zeros(dim)))
        words = codes.shape[1]
        code = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * words, pa.int32()),
                                        pa.array(codes.reshape(-1).view(np.int64)))
        return pa.table({"vec_id": table.column("vec_id"), "vec": table.column("vec"), "dim": table.column("dim"),
                         "code": code, "length": pa.array(length), "match": pa.array(match)})

    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(4096)))
    indexed = stored(rows.groupBy("dim", "part").applyInArrow(
        index, "vec_id long, vec array<double>, dim int, code array<long>, length double, match double"))
    condition = (F.col("vec_id") % 20 == 0) if is_query is None else is_query
    queries = indexed.filter(condition).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), "dim")
    n, n_queries = indexed.count(), queries.count()
    slices, blocks = max(MIN_SLICES, -(-n // SLICE_ROWS)), max(1, -(-n_queries // QUERY_BLOCK))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))) \
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    held = indexed.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(key, asked, held):
        out = [[], [], [], []]
        if asked.num_rows and held.num_rows:
            dim = key[0].as_py()
            ids = held.column("vec_id").to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            x = _matrix(held.column("vec"), dim, np.float64)[by_id]
            codes = _matrix(held.column("code"), -(-dim // 64), np.int64)[by_id].view(np.uint64)
            length, match = (held.column(c).to_numpy()[by_id] for c in ("length", "match"))
            q_ids, q = asked.column("query_id").to_numpy(), _matrix(asked.column("query"), dim, np.float64)
            centre = shared.value.get(dim, np.zeros(dim))
            step = max(1, (1 << 20) // len(ids))
            for a in range(0, len(q), step):
                value, bound = estimates(q[a:a + step], centre, codes, length, match, sigmas)
                for r in range(len(value)):
                    own = ids == q_ids[a + r]
                    value[r, own] = -np.inf
                    first = np.argpartition(-value[r], min(4 * k, len(ids)) - 1)[:4 * k]
                    score = (x[first] * q[a + r]).sum(axis=1)
                    score[own[first]] = -np.inf
                    floor = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
                    maybe = np.flatnonzero((value[r] + bound[r] >= floor) & ~own)
                    score = (x[maybe] * q[a + r]).sum(axis=1)
                    best = np.lexsort((maybe, -score))[:k]
                    out[0].append(np.full(len(best), q_ids[a + r]))
                    out[1].append(ids[maybe[best]])
                    out[2].append(score[best])
                    out[3].append(np.full(len(best), a + r))
        cat = [np.concatenate(c) if c else np.zeros(0) for c in out[:3]]
        keys = asked.column("query_key").to_numpy()[np.concatenate(out[3])] if out[3] else np.zeros(0)
        return pa.table({"query_id": pa.array(cat[0].astype(np.int64)), "query_key": pa.array(keys.astype(np.int64)),
                         "vec_id": pa.array(cat[1].astype(np.int64)), "score": pa.array(cat[2].astype(np.float64))})

    asked = asked.withColumn("query_key", F.xxhash64("query"))
    found = asked.groupBy("dim", "block", "slice").cogroup(held.groupBy("dim", "block", "slice")) \
        .applyInArrow(search, "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_rotated_codes_ann(spark, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 20 against all rows of ``embeddings``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
