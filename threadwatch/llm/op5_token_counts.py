"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwatch.llm.pieces import Encoder, Memory, space_led_pieces
from threadwatch.llm.words import slices_by_bytes
from threadwatch.session import ship_package

VOCABULARY = "byte_bpe_50k.json"
SLICE_BYTES = 1 << 20


def _count(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, encoder = Memory.of("lengths", vocabulary), Encoder.of(vocabulary)

        def learn(pieces):
            return {p: len(ids) // 4 for p, ids in encoder.encode(pieces).items()}

        for whole in batches:
            for batch in slices_by_bytes(whole, "_text", SLICE_BYTES):
                texts = [t or "" for t in batch.column("_text").to_pylist()]
                cut = [space_led_pieces(t) if t else [] for t in texts]
                lengths = memory.lookup(cut, learn)
                totals = [sum(map(lengths.__getitem__, pieces)) for pieces in cut]
                size = np.array([len(t.encode()) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "_text"]
                    + [pa.array(size), pa.array(totals, pa.int64())],
                    names=[n for n in batch.schema.names if n != "_text"] + ["n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, *, text_col: str = "text", vocabulary: str = VOCABULARY,
                 carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, ``n_bytes`` (UTF-8) and ``n_tokens`` of every text, one row per input row.

    Tokens are counted as ``tokenizers`` gives them for ``vocabulary`` (a file name of the
    installed public vocabularies or a path that every executor can read) without added
    special tokens; special strings inside texts are special tokens, its default.  A null
    or empty text has 0 of both; null ids and repeated rows are rows like others.  Texts
    are cut before white space that follows other characters: no byte-level token crosses
    such a place, so a text of any length is encoded in small parts.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("_row"),
                       F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([kept.schema["_row"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    return kept.mapInArrow(_count(vocabulary), schema) \
        .select(*[F.col("_row")[c].alias(c) for c in carry], "n_bytes", "n_tokens")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` in tokens of the 50k byte-level vocabulary."""
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
