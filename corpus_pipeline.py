"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one gets as
its ``docs``, written as Parquet and read again.  All but the last return the columns of
``docs``.  Extra columns pass through whatever their names.  Rows without a doc_id get a
stand-in from their text while a stage compares rows; rows that share a doc_id are parts of
one document and stay or go together when their texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwatch.llm import op1_decontamination, op2_substring, op3_quality, op6_near_dup, op9_packing
from threadwatch.llm.tables import stored

#: the result holds packed token ids, trained scores and hashes, none of which SQL expresses
ORACLE_SQL = None


def _key() -> Column:
    """doc_id, or a large number made from the text where there is none."""
    own = F.xxhash64(F.lit("no id"), F.col("text")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col("doc_id").cast("long"), own)


def _whole(docs: DataFrame, *drop: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in drop])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; rows that share a doc_id are judged each by its own text."""
    machine = op3_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op3_quality.accepted(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    judged = op6_near_dup.near_duplicates(docs.select(_key().alias("doc_id"), "text"))
    kept = judged.filter("kept").select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(_key().alias("key"), _whole(docs).alias("row"))
    return rows.join(kept, "key", "left_semi").select("row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier in the corpus; ``n_chars`` follows the text."""
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), _whole(docs, "doc_id", "text").alias("rest"))
                       .alias("row") if len(docs.columns) > 2 else F.struct(F.lit(0).alias("_")).alias("row"))
    kept = op2_substring.remove_repeats(rows, carry=("row",), spans=False, keep_layout=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    columns = []
    for c in docs.columns:
        if c == "n_chars":
            changed = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema[c].dataType))
            columns.append(changed.otherwise(F.col("row.rest")[c]).alias(c))
        elif c in new:
            columns.append(new[c].cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row.rest")[c].alias(c))
    return kept.select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; of rows that share a doc_id, one that holds an item takes all along."""
    found = op1_decontamination.contaminated(docs.select(_key().alias("doc_id"), "text"),
                                             spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = docs.select(_key().alias("key"), _whole(docs).alias("row"))
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 2048 tokens."""
    return op9_packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
