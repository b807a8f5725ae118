"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

A text's score takes one pass over its features: the pairwise interactions of a low rank
are summed by the sum-of-squares identity, so they cost no more than the linear part.  The
machine is fitted on a bounded sample of labelled texts (``sample`` rows, those with the
smallest hash of their id); everything else covers every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwatch.llm.words import U64, Words, slices_by_bytes
from threadwatch.llm.workers import begin
from threadwatch.session import ship_package

WORD_FEATURES = 4096
RANK = 8
BINS = 12
SAMPLE = 12_000
EPOCHS = 12
THRESHOLD = 0.3

LINE_SEPARATORS = np.zeros(256, bool)
LINE_SEPARATORS[[10, 13]] = True


def _class(*ranges) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for r in ranges:
        table[r] = 1
    return table


#: bytes counted for the structure statistics
CLASSES = {
    "upper": _class(slice(0x41, 0x5B)), "lower": _class(slice(0x61, 0x7B)), "digit": _class(slice(0x30, 0x3A)),
    "wide": _class(slice(0xC0, 0x100)), "end": _class([0x21, 0x2E, 0x3F]), "comma": _class([0x2C, 0x3A, 0x3B]),
    "exclaim": _class([0x21]), "bar": _class([0x7C]), "mark": _class([*range(0x23, 0x27), 0x2A, 0x40, 0x5E, 0x7E]),
    "bracket": _class([0x28, 0x29, 0x3C, 0x3E, 0x5B, 0x5D, 0x7B, 0x7D]), "line": _class([10]),
}
STATISTICS = [*CLASSES, "bytes", "words", "word_length", "distinct", "hapax", "again", "top", "lines_distinct",
              "line_words"]


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, word feature index, value, statistics) of a batch of texts.

    Word values are counts damped by a logarithm and scaled to unit length per text.
    """
    words = Words(column)
    n = len(words.counts)
    hashes = words.hashes()
    sizes = np.diff(words.offsets)
    stats = np.zeros((n, len(STATISTICS)), np.float64)
    full = sizes > 0
    if full.any():
        for i, table in enumerate(CLASSES.values()):
            stats[full, i] = np.add.reduceat(table[words.buf], words.offsets[:-1][full], dtype=np.int64) / sizes[full]
    order = np.lexsort((hashes, words.doc))
    h, d = hashes[order], words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    times, d, h = np.diff(np.append(at, len(h))), d[at], h[at]
    count = np.maximum(words.counts, 1)
    again = np.bincount(words.doc[1:][(hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, d, times)
    lines = Words(column, LINE_SEPARATORS)
    lh = lines.hashes()
    different = np.unique(lh ^ (lines.doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    n_lines = np.maximum(lines.counts, 1)
    k = len(CLASSES)
    stats[:, k:] = np.stack([
        np.log1p(sizes), np.log1p(words.counts), _mean_length(words), np.bincount(d, minlength=n) / count,
        np.bincount(d[times == 1], minlength=n) / count, again / count, top / count,
        np.bincount(lines.doc[different], minlength=n) / n_lines, np.log1p(words.counts / n_lines)], axis=1)
    key = d * WORD_FEATURES + (h >> U64(40)).astype(np.int64) % WORD_FEATURES
    key, group = np.unique(key, return_inverse=True)
    value = np.log1p(np.bincount(group, weights=times, minlength=len(key)))
    doc = key // WORD_FEATURES
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=n))
    offsets = np.searchsorted(key, np.arange(n + 1) * WORD_FEATURES)
    return offsets, key % WORD_FEATURES, value / np.maximum(norm, 1e-12)[doc], stats


def _mean_length(words: Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(words.end - words.start)])
    return (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(words.counts, 1)


class Machine:
    """w0 + <w, x> + pairwise interactions <v_i, v_j> x_i x_j, by the sum-of-squares identity."""

    def __init__(self, edges: np.ndarray, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        self.edges, self.mean, self.spread = edges, mean, spread
        self.size = WORD_FEATURES + len(STATISTICS) * (BINS + 1)
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(self.size)
        self.v = rng.normal(0, 0.05, (self.size, RANK))

    def expand(self, offsets, index, value, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One sparse row per text: word features, then each statistic scaled and as an indicator of its bin."""
        n, s = stats.shape
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / 4
        bins = np.stack([np.searchsorted(self.edges[:, j], stats[:, j], "right") for j in range(s)], axis=1)
        first = WORD_FEATURES + np.arange(s) * (BINS + 1)
        extra_index = np.concatenate([np.broadcast_to(first, (n, s)), first + 1 + bins], axis=1)
        extra_value = np.concatenate([scaled, np.full((n, s), 0.5)], axis=1)
        counts = np.diff(offsets)
        ends = np.cumsum(counts + 2 * s)
        out_index, out_value = np.empty(ends[-1] if n else 0, np.int64), np.empty(ends[-1] if n else 0)
        is_extra = np.zeros(len(out_index), bool)
        for j in range(2 * s):
            is_extra[ends - 1 - j] = True
        out_index[is_extra], out_value[is_extra] = extra_index.reshape(-1), extra_value.reshape(-1)
        out_index[~is_extra], out_value[~is_extra] = index, value
        return np.concatenate([[0], ends]), out_index, out_value

    def raw(self, offsets, index, value) -> tuple[np.ndarray, np.ndarray]:
        """(margin, per-text factor sums); every text has the statistics, so no segment is empty."""
        starts = offsets[:-1]
        linear = np.add.reduceat(self.w[index] * value, starts)
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.w0 + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, offsets, index, value, stats) -> np.ndarray:
        if len(stats) == 0:
            return np.zeros(0)
        margin, _ = self.raw(*self.expand(offsets, index, value, stats))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def fit(self, offsets, index, value, stats, labels, *, epochs: int = EPOCHS, rate: float = 0.02,
            decay: float = 1e-4, batch: int = 256, seed: int = 11) -> "Machine":
        """Adam on the logistic loss."""
        offsets, index, value = self.expand(offsets, index, value, stats)
        rng = np.random.default_rng(seed)
        self.w0 = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.v)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for a in range(0, len(order), batch):
                rows = order[a:a + batch]
                counts = offsets[rows + 1] - offsets[rows]
                ends = np.cumsum(counts)
                pick = np.arange(ends[-1]) - np.repeat(ends - counts - offsets[rows], counts)
                i, x = index[pick], value[pick]
                margin, sums = self.raw(np.concatenate([[0], ends]), i, x)
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]
                step += 1
                self.w0 -= rate * error.mean()
                e = np.repeat(error, counts) / len(rows)
                grads = (np.bincount(i, weights=e * x, minlength=self.size),
                         np.stack([np.bincount(i, weights=e * x * (np.repeat(sums[:, f], counts) - self.v[i, f] * x),
                                               minlength=self.size) for f in range(RANK)], axis=1))
                for p, g, (m, s) in zip((self.w, self.v), grads, state):
                    g = g + decay * p
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
        return self


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("quality")
    for whole in batches:
        for batch in slices_by_bytes(whole, "_text"):
            offsets, index, value, stats = features(batch.column("_text"))
            off = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), batch.column("label"), pa.ListArray.from_arrays(off, pa.array(index, pa.int32())),
                pa.ListArray.from_arrays(off, pa.array(value, pa.float32())),
                pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1) * stats.shape[1], pa.int32()),
                                         pa.array(stats.reshape(-1)))],
                names=["_id", "label", "idx", "val", "stats"])


def training_ids(labels: DataFrame, sample: int, fold: int = 5) -> DataFrame:
    """(doc_id, label) of the ``sample`` labelled ids outside the held-out fold with the smallest hash."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")) \
        .filter("doc_id is not null and label is not null") \
        .filter(F.crc32(F.col("doc_id").cast("string")) % fold != 0) \
        .groupBy("doc_id").agg(F.max("label").alias("label")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Machine | None:
    """A machine fitted on at most ``sample`` labelled texts; None if there are none."""
    ship_package(docs.sparkSession)
    chosen = F.broadcast(training_ids(labels, sample).withColumnRenamed("doc_id", "_id"))  # at most ``sample`` rows
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")) \
        .join(chosen, "_id").select("_id", "label", "_text")
    table = rows.mapInArrow(
        _extract, "_id long, label int, idx array<int>, val array<float>, stats array<double>").toArrow().combine_chunks()
    if table.num_rows == 0:
        return None
    idx, val, st = (table.column(c).combine_chunks() for c in ("idx", "val", "stats"))
    if isinstance(idx, pa.ChunkedArray):
        idx, val, st = (x.chunk(0) for x in (idx, val, st))
    offsets = np.asarray(idx.offsets, np.int64)
    index, value = np.asarray(idx.values, np.int64), np.asarray(val.values, np.float64)
    stats = np.asarray(st.values, np.float64).reshape(table.num_rows, -1)
    y = table.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*stats.T, table.column("_id").to_numpy()))  # the same fit whatever order the rows arrive in
    counts = np.diff(offsets)[order]
    pick = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - offsets[order], counts)
    index, value, stats, y = index[pick], value[pick], stats[order], y[order]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0)
    machine = Machine(edges, stats.mean(axis=0), stats.std(axis=0) + 1e-9)
    return machine.fit(offsets, index, value, stats, y)


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for whole in batches:
            for batch in slices_by_bytes(whole, "_text"):
                s = machine.score(*features(batch.column("_text"))) if machine else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(s, pa.float64())], names=["_row", "score"])

    return score


def score_quality(docs: DataFrame, machine: Machine | None, *, text_col: str = "text",
                  carry: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The ``carry`` columns, ``score`` in [0, 1] and ``predicted`` (1 from ``threshold`` on), one row per input row.

    A null or empty text is scored from its statistics, all zero.  Without a machine (no
    labelled text) every score is 0.5.  Ids, null or repeated, play no part.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(machine)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    from pyspark.sql import types as T
    schema = T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(model), schema) \
        .select(*[F.col("_row")[c].alias(c) for c in carry], "score") \
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def _accept(model, text_col: str, threshold: float):
    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        machine = model.value
        for whole in batches:
            for batch in slices_by_bytes(whole, text_col):
                text = batch.column(batch.schema.get_field_index(text_col))
                s = machine.score(*features(text)) if machine else np.full(batch.num_rows, 0.5)
                yield batch.filter(pa.array(s >= threshold))
            pa.default_memory_pool().release_unused()

    return accept


def accepted(docs: DataFrame, machine: Machine | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score ``threshold`` or more, with the columns of ``docs`` and no others.

    Rows go to the workers once, as they are, and only those kept come back.  Null and empty
    texts, null and repeated ids as in ``score_quality``; without a machine every row scores
    0.5.  Rows that share an id are judged each by its own text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    return docs.mapInArrow(_accept(spark.sparkContext.broadcast(machine), text_col, threshold), docs.schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learnt from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, machine).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", "predicted")
