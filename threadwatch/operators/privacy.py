"""Pseudonymisation and text scrubbing.

* P1 dense pseudonyms ``author_<k>`` by first appearance, continuing an
  existing map: new authors are ranked with ``rank_within`` (range partitions
  and their offsets), never with a one-partition window.
* P2 is a left join with the map.
* P3 replaces every known name occurring anywhere in a text, longest names
  first: names claim spans of the text in one total order.  Rolling hashes of
  the texts are joined with the names; nothing is collected.
* P4 / P5 are regular expressions plus one Arrow-batched NFKC step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwatch.functions.fixed import PSEUDONYM_PREFIX
from threadwatch.operators import spans
from threadwatch.operators.ranking import rank_within
from threadwatch.session import cut_lineage, ship_package


def first_appearance(comments: DataFrame, author: str = "author", order_key: str = "published_at") -> DataFrame:
    """``(author, first_key)``: the earliest order key of each author (partial aggregation)."""
    return comments.filter(F.col(author).isNotNull()).groupBy(author).agg(F.min(order_key).alias("first_key"))


def assign_pseudonyms(first_seen: DataFrame, existing: DataFrame | None = None, author: str = "author",
                      order_key: Column | None = None, prefix: str = PSEUDONYM_PREFIX) -> DataFrame:
    """The full map ``(author, author_anon)``; existing entries keep their pseudonym.

    New authors get ``prefix + k`` with k = size of the existing map + their
    rank by ``(first_key, author)``; the key is compared in its own type, and
    authors without one come last.  No author is left out.
    """
    key = order_key if order_key is not None else F.col("first_key")
    if existing is None:
        new, offset = first_seen, 0
    else:
        new = first_seen.join(existing.select(author), author, "left_anti")
        offset = existing.count()  # one scalar
    ranked = rank_within(new, key, [author], None, "_r")
    fresh = ranked.select(author, F.concat(F.lit(prefix), (F.col("_r") + offset).cast("string")).alias("author_anon"))
    return fresh if existing is None else existing.select(author, "author_anon").unionByName(fresh)


def replace_authors(df: DataFrame, amap: DataFrame, author: str = "author") -> DataFrame:
    """Author -> pseudonym; unknown authors unchanged."""
    m = amap.select(F.col("author").alias("_a"), F.col("author_anon").alias("_anon"))
    j = df.join(m, df[author] == m["_a"], "left")
    return j.withColumn(author, F.coalesce(F.col("_anon"), F.col(author))).drop("_a", "_anon")


HANDLE_NAME = r"^@[^@\s]+$"


def replace_handle_names(df: DataFrame, text_col: str, amap: DataFrame, id_col: str) -> DataFrame:
    """P3 for ``@handle`` names (no inner ``@`` or whitespace), as joins only.

    Such a name can only start at an ``@``: the text is split at every ``@``;
    each piece's prefixes (no longer than the longest name) are equi-joined
    with the names; the longest hit is replaced and the pieces are joined back
    in order.  No dictionary is broadcast or collected, so the map may be as
    large as the corpus.  ``id_col`` must identify the rows of ``df``.
    """
    names = amap.select(F.col("author").alias("_name"), F.concat(F.lit("@"), F.col("author_anon")).alias("_repl")) \
                .filter(F.col("_name").rlike(HANDLE_NAME))
    max_len = names.agg(F.max(F.length("_name"))).first()[0] or 0
    seg = df.select(id_col, F.posexplode(F.split(F.col(text_col), "@", -1)).alias("_pos", "_seg"))
    cand = seg.filter(F.col("_pos") >= 1).select(
        id_col, "_pos", F.explode(F.sequence(F.lit(1), F.least(F.length("_seg"), F.lit(max(max_len - 1, 1)))))
        .alias("_k"), "_seg")
    cand = cand.filter(F.col("_k") <= F.length("_seg")).withColumn(
        "_pref", F.concat(F.lit("@"), F.substring(F.col("_seg"), F.lit(1), F.col("_k"))))
    hits = cand.join(names, cand["_pref"] == names["_name"], "inner").groupBy(id_col, "_pos").agg(
        F.max_by(F.struct("_k", "_repl"), F.col("_k")).alias("_best"))
    seg = seg.join(hits, [id_col, "_pos"], "left")
    piece = (F.when(F.col("_pos") == 0, F.col("_seg"))
             .when(F.col("_best").isNull(), F.concat(F.lit("@"), F.col("_seg")))
             .otherwise(F.concat(F.col("_best._repl"), F.substring(F.col("_seg"), F.col("_best._k") + 1, 1 << 30))))
    rebuilt = seg.groupBy(id_col).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("_pos"), piece.alias("p")))), lambda x: x["p"]), "")
        .alias("_new"))
    out = df.join(rebuilt, id_col, "left")
    return out.withColumn(text_col, F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(F.col("_new"))) \
              .drop("_new")


def _replace(text_col: str):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for n, hits in enumerate(batch.column("_hits").to_pylist()):
                if hits:
                    claims = spans.longest_first([(h["start"], h["name"], h["repl"]) for h in hits])
                    texts[n] = spans.replace_claims(texts[n], claims)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[:-1], names=batch.schema.names[:-1])

    return replace


def replace_names(df: DataFrame, text_col: str, amap: DataFrame) -> DataFrame:
    """Every known author name in ``text_col`` -> ``@<pseudonym>``, longest names first.

    Names claim spans of the original text in the order (longer, then by name), each from
    left to right; a span that a longer name holds is closed to shorter ones, and what was
    put in is never read again.  Occurrences come from a join of the texts' rolling hashes
    with the names (``spans.occurrences``); the claims of one text are settled together, so
    a group is as large as its text.  Neither names nor texts pass through the driver.  A
    name that stands for several pseudonyms gets the smallest.  Null and empty names and
    null texts take no part.  For maps of ``@handle`` names prefer ``replace_handle_names``.
    """
    ship_package(df.sparkSession)
    names = cut_lineage(
        amap.select(F.col("author").alias("name"), F.concat(F.lit("@"), F.col("author_anon")).alias("repl"))
        .filter(F.col("name").isNotNull() & (F.col("name") != "") & F.col("repl").isNotNull())
        .groupBy("name").agg(F.min("repl").alias("repl")))
    keyed = cut_lineage(df.withColumn("_key", F.monotonically_increasing_id()))
    found = spans.occurrences(keyed.select(F.col("_key").alias("key"), F.col(text_col).alias("text")), names)
    hits = found.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "name", "repl")).alias("_hits"))
    return keyed.join(hits, "_key", "left").select(*df.columns, "_hits").mapInArrow(_replace(text_col), df.schema)
