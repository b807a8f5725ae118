"""Readers for the landed corpus tree ``{stage}/{newspaper}/{file_id}[_gold|_silver].{csv,json}``.

Files are listed, dealt and read by ``sources.files``, hidden names included.  The result is
one typed table per stage; land it as Parquet once and run every later stage from there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwatch.operators.privacy import assign_pseudonyms
from threadwatch.operators.risk import parse_annotated_name
from threadwatch.session import cut_lineage
from threadwatch.sources import versions
from threadwatch.sources.files import TASK_BYTES, dealt, list_files, place_of, read_csv_files

COMMENT_FIELDS = ["comment_id", "parent_comment_id", "video_id", "is_reply", "author", "published_at",
                  "updated_at", "like_count", "text", "inferred_parent_id", "depth", "newspaper",
                  "author_anon", "label", "type"]
META_FIELDS = ["video_id", "title", "channel", "published_at", "description", "tags", "view_count",
               "like_count", "comment_count", "topic", "type", "annotator_number"]


def _nullable(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return str(v)


def read_comment_files(spark: SparkSession, root: str, *, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(rows, files)`` for every ``*.csv`` under ``root``.

    ``rows`` has the comment columns as text plus ``path``/``newspaper_dir``; ``files`` has
    one row per file with its row count, column count and a status (``ok``, ``empty`` for a
    file without a header, ``error``), so header-only and empty files still count as videos
    with zero comments.  See ``files.read_csv_files``.
    """
    rows, files = read_csv_files(spark, root, COMMENT_FIELDS, task_bytes=task_bytes)
    return _with_path_keys(rows), _with_path_keys(files)


def _metadata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                system, inner, _ = place_of(path)
                with system.open_input_stream(inner) as f:
                    md = json.loads(f.read().decode("utf-8"))
                topic = md.get("topic")
                if isinstance(topic, (list, tuple)):
                    topic = topic[0] if topic else None
                values, status = [_nullable(topic if c == "topic" else md.get(c)) for c in META_FIELDS], "ok"
            except (OSError, ValueError, AttributeError):  # unreadable, not JSON, not an object
                values, status = [None] * len(META_FIELDS), "error"
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (*values, path, status)],
                                             names=[*META_FIELDS, "path", "status"])


def read_metadata_files(spark: SparkSession, root: str, *, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per ``*.json`` file; unreadable files have ``status = 'error'`` (counted, not lost).

    A list-valued topic keeps its first element; an empty list is null.  Each file is read
    once, in tasks of about ``task_bytes``, and the result is stored.
    """
    schema = ", ".join(f"{c} string" for c in [*META_FIELDS, "path", "status"])
    paths = dealt(list_files(spark, root, ".json"), task_bytes).select("path")
    return _with_path_keys(cut_lineage(paths.mapInArrow(_metadata, schema)))


def _with_path_keys(df: DataFrame) -> DataFrame:
    """``newspaper`` (parent folder), ``file_id`` and ``kind`` (S3) from the path."""
    fid, kind = parse_annotated_name(F.col("path"))
    name = F.regexp_extract("path", r"([^/]+)\.(csv|json)$", 1)
    return df.withColumn("newspaper_dir", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)) \
             .withColumn("file_id", F.coalesce(fid, name)).withColumn("kind", kind)


def typed_comments(rows: DataFrame) -> DataFrame:
    """Cast the text columns of S1 to the comment schema (ANSI-safe ``try_cast``)."""
    b = F.lower(F.col("is_reply"))
    return rows.select(
        "comment_id", "parent_comment_id", "video_id",
        F.when(b == "true", True).when(b == "false", False).alias("is_reply"),
        "author", F.col("published_at").try_cast("timestamp").alias("published_at"),
        F.col("updated_at").try_cast("timestamp").alias("updated_at"),
        F.col("like_count").try_cast("double").cast("bigint").alias("like_count"), "text",
        "inferred_parent_id", F.col("depth").try_cast("double").cast("int").alias("depth"),
        F.coalesce("newspaper", "newspaper_dir").alias("newspaper"), "author_anon",
        F.col("label").try_cast("double").alias("label"), "type", "file_id", "kind", "path")


def annotator_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """The annotators' workload tree ``root/<annotator>/.../<newspaper>/<file>``, long form."""
    paths = list_files(spark, root, suffix)
    rel = F.regexp_extract("path", r"^.*?/" + re.escape(root.rstrip("/").split("/")[-1]) + r"/(.*)$", 1)
    return paths.select(
        F.split(rel, "/").getItem(0).alias("annotator"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("newspaper"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "path") \
        .withColumn("file_id", F.regexp_extract("filename", r"^([^.]+)", 1))


def comment_file_table(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Per comment file: ``(newspaper, file_id, kind, num_comments, num_offensive_comments)``.

    Built from the file listing, so header-only and 0-byte files count as 0 comments;
    a file without a ``label`` column counts no offensive comment.
    """
    from threadwatch.operators.risk import numeric_label
    stats = rows.groupBy("path").agg(F.count_if(numeric_label(F.col("label")) == 1).alias("n_off"))
    f = files.join(stats, "path", "left")
    return f.select(F.col("newspaper_dir").alias("newspaper"), "file_id", "kind",
                    F.col("n_rows").alias("num_comments"),
                    F.coalesce("n_off", F.lit(0)).cast("bigint").alias("num_offensive_comments"))


def load_author_map(spark: SparkSession, path: str) -> DataFrame:
    """The author map, or an empty one when nothing was saved at ``path``; an unreadable map raises."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.parquet(path)
    return spark.createDataFrame([], "author string, author_anon string")


def save_author_map(amap: DataFrame, path: str) -> None:
    """Write a new version (never overwrite the map being read)."""
    amap.write.mode("errorifexists").parquet(path)


def extend_author_map(spark: SparkSession, root: str, first_seen: DataFrame, tries: int = 5) -> int:
    """S8 + P1: add the authors of ``first_seen(author, first_key)`` to the versioned map at ``root``; its new version.

    Numbers go on from those of the version that was read.  If another run commits in between,
    the new authors are numbered again on top of its map, at most ``tries`` times, so no
    number is given twice.  Without new authors nothing is written.
    """
    for _ in range(tries):
        version, amap = versions.read_table(spark, root, "author string, author_anon string")
        extended = cut_lineage(assign_pseudonyms(first_seen, amap))
        if extended.count() == amap.count():
            return version
        try:
            return versions.publish_table(extended, root, version)
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{root}: other runs committed {tries} times in between")


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames with possibly different columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
