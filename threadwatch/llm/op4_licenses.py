"""License scans by diagonal voting.

All rolling word k-grams of the texts are hashed; those that any template holds join the
templates' positions in Spark.  A match at word p of a text and word t of a template votes
for the diagonal p - t, the place where the template would start.  Neighbouring diagonals
are merged, so that a word more or less does not break a span, and spans are verified by
the share of the template's grams they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadwatch.llm.words import ALNUM_SEPARATORS, LOWER_CASE, Words, slices_by_bytes, window_hashes
from threadwatch.session import ship_package

GRAM = 3
#: how far apart two diagonals may be to count as one placement
DRIFT = 3
#: share of a template's grams that a span must hold
SHARE = 0.6
#: notices with fewer grams must be there whole, as versions differ in a word
SHORT = 12

#: (label, phrase): exact phrases
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# Opening words of well-known license notices, found with small changes, too.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: words of all templates together, a bound of what is broadcast
MAX_TEMPLATE_WORDS = 100_000


def grams_of(column, k: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, start word of each k-gram, its hash)."""
    words = Words(column, ALNUM_SEPARATORS, LOWER_CASE)
    wide = window_hashes(words.hashes(), k)
    at = np.flatnonzero(words.doc[:len(wide)] == words.doc[k - 1:]) if len(wide) else np.zeros(0, np.int64)
    return words, at, wide[at]


def template_positions(templates: list[tuple[str, str]], exact: int, k: int) -> list[tuple[int, int, int, int]]:
    """(gram hash, template number, position, grams of the template)."""
    if sum(len(t.split()) for _, t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError("templates are too long to be broadcast")
    words, at, hashes = grams_of(pa.array([t for _, t in templates]), k)
    doc = words.doc[at]
    n = np.bincount(doc, minlength=len(templates))
    if (n == 0).any():
        raise ValueError(f"a template has fewer than {k} words")
    return list(zip(hashes.view(np.int64).tolist(), doc.tolist(), (at - words.first[doc]).tolist(), n[doc].tolist()))


def _scan(wanted: np.ndarray, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.zeros(1 << 16, bool)
        low[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
        for whole in batches:
            for batch in slices_by_bytes(whole, "_text"):
                words, at, hashes = grams_of(batch.column("_text"), k)
                maybe = low[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
                at, hashes = at[maybe], hashes[maybe]
                sure = np.isin(hashes, wanted)
                at, hashes = at[sure], hashes[sure]
                doc = words.doc[at]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
                hits = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(at - words.first[doc])],
                                                  names=["gram", "p"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("_key"), batch.column("_row"), pa.array(words.counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)],
                    names=["_key", "_row", "n_words", "hits"])

    return scan


def scan_licenses(docs: DataFrame, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
                  phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES,
                  gram: int = GRAM, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """License phrases and notices in every text, one row per input row.

    A-Z are lower-cased; words are runs of letters, digits and non-ASCII characters.
    Returns the ``carry`` columns, n_words, n_base (places of the exact phrases),
    first_word and last_word (their smallest and largest start), base_labels, labels (with
    the notices') and spans (label, start, end exclusive, share of the template's grams),
    and score, the greatest share, 0 without a span.  A null or empty text has no words and
    no labels.  Rows with null or repeated ids are judged one by one.  Templates must have
    ``gram`` words or more.
    """
    spark = docs.sparkSession
    ship_package(spark)
    templates = [*phrases, *notices]
    positions = template_positions(templates, len(phrases), gram)
    wanted = np.unique(np.array([p[0] for p in positions], np.int64).view(np.uint64))
    places = F.broadcast(spark.createDataFrame(positions, "gram long, template int, t int, grams int"))  # bounded above
    names = F.create_map(*[F.lit(x) for i, (label, _) in enumerate(templates) for x in (i, label)])
    keyed = docs.select(F.monotonically_increasing_id().alias("_key"),
                        F.struct(F.lit(0).alias("_"), *carry).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("_key", T.LongType()), keyed.schema["_row"], T.StructField("n_words", T.LongType()),
                           T.StructField("hits", T.ArrayType(T.StructType([T.StructField("gram", T.LongType()),
                                                                          T.StructField("p", T.LongType())])))])
    scanned = keyed.mapInArrow(_scan(wanted, gram), schema)
    votes = scanned.select("_key", "_row", "n_words", F.explode_outer("hits").alias("hit")) \
        .select("_key", "_row", "n_words", F.col("hit.gram").alias("gram"), F.col("hit.p").alias("p")) \
        .join(places, "gram", "left") \
        .withColumn("diagonal", F.col("p") - F.col("t"))
    own = Window.partitionBy("_key", "template").orderBy("diagonal")
    exact = F.col("template") < len(phrases)
    apart = F.col("diagonal") - F.lag("diagonal").over(own) > F.when(exact, 0).otherwise(drift)
    merged = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")) \
        .withColumn("placement", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("_key", "template", "placement").agg(
        F.first("_row").alias("_row"), F.first("n_words").alias("n_words"), F.min("p").alias("start"),
        (F.max("p") + gram).alias("end"), F.count_distinct("t").alias("held"), F.first("grams").alias("grams")) \
        .withColumn("share", F.col("held") / F.col("grams")).withColumn("label", names[F.col("template")]) \
        .withColumn("base", exact & (F.col("held") == F.col("grams"))) \
        .withColumn("found", F.col("base") | (
            ~exact & (F.col("share") >= F.when(F.col("grams") < SHORT, F.lit(1.0)).otherwise(share))))
    base = F.when(F.col("base"), F.col("start"))
    label = F.when(F.col("found"), F.col("label"))
    joined = spans.groupBy("_key").agg(
        F.first("_row").alias("_row"), F.first("n_words").alias("n_words"),
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("start", "end", "label", "share")))).alias("spans"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("share"))), F.lit(0.0)).alias("score"))
    return joined.select(*[F.col("_row")[c].alias(c) for c in carry], "n_words", "n_base", "first_word", "last_word",
                         "base_labels", "labels", "spans", "score")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
