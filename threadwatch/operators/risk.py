"""Per-video risk dataset.

Shape of the job: one partial (map-side combined) aggregation of the comment
table per comment file, one ``min_by`` per file key to pick gold over silver,
and one full outer join of two tables that are both unique on
``(newspaper, file_id)`` and already hash-partitioned on it by the preceding
aggregations, so the join adds no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwatch.functions.fixed import LAMBDA, OFFENSIVE_THRESHOLD
from threadwatch.functions.scoring import offensive_score, offensive_trigger
from threadwatch.functions.text import unicode_strip

KEYS = ["newspaper", "file_id"]
DATASET_COLUMNS = [
    "video_id", "newspaper", "video_text", "video_description", "video_topic",
    "num_comments", "num_offensive_comments", "offensive_score", "offensive_trigger",
    "type",
]


def kind_precedence(kind: Column) -> Column:
    """gold before silver before anything else."""
    return F.when(kind == "gold", 0).when(kind == "silver", 1).otherwise(2)


def parse_annotated_name(path: Column) -> tuple[Column, Column]:
    """``.../<file_id>_(gold|silver).(csv|json)`` -> (file_id, kind); others give nulls."""
    pat = r"([^/]+)_(gold|silver)\.(csv|json)$"
    fid = F.regexp_extract(path, pat, 1)
    kind = F.regexp_extract(path, pat, 2)
    return F.when(fid != "", fid), F.when(kind != "", kind)


def pick_annotated(files: DataFrame, keys: list[str] = KEYS, kind_col: str = "kind") -> DataFrame:
    """One annotated file per key, gold over silver, whole-file choice."""
    payload = [c for c in files.columns if c not in keys]
    picked = files.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), kind_precedence(F.col(kind_col))).alias("_p"))
    return picked.select(*keys, "_p.*")


def numeric_label(label: Column) -> Column:
    """Label as text / float / int -> double, null when not numeric."""
    return label.cast("string").try_cast("double")


def comment_stats(comments: DataFrame, keys: list[str], label_col: str | None = "label") -> DataFrame:
    """R2: rows and rows whose numeric label is 1; a missing label column counts 0."""
    off = (F.count_if(numeric_label(F.col(label_col)) == 1) if label_col and label_col in comments.columns
           else F.lit(0).cast("bigint"))
    return comments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_comments"), off.alias("num_offensive_comments"))


def score_columns(df: DataFrame, n: str = "num_comments", n_off: str = "num_offensive_comments",
                  lambda1: float = LAMBDA, threshold: float = OFFENSIVE_THRESHOLD) -> DataFrame:
    """R5 + R6: stored score rounded to 4, trigger on the unrounded score."""
    s = offensive_score(F.col(n), F.col(n_off), lambda1)
    return df.withColumn("_s", s).withColumn("offensive_score", F.round("_s", 4)) \
             .withColumn("offensive_trigger", offensive_trigger(F.col("_s"), threshold)).drop("_s")


def resolve_type(meta_type: Column, comm_type: Column) -> Column:
    """A single source tag; ``''`` when neither side, ``meta/comments`` on disagreement."""
    return (F.when(meta_type.isNull() & comm_type.isNull(), F.lit(""))
            .when(meta_type.isNull(), comm_type)
            .when(comm_type.isNull() | (meta_type == comm_type), meta_type)
            .otherwise(F.concat(meta_type, F.lit("/"), comm_type)))


def build_dataset(meta_files: DataFrame, comment_rows: DataFrame, *, lambda1: float = LAMBDA,
                  threshold: float = OFFENSIVE_THRESHOLD, with_flags: bool = False) -> DataFrame:
    """The per-video dataset.

    ``meta_files``: ``(newspaper, file_id, kind, title, description, topic)``, one
    row per annotated metadata file.  ``comment_rows``: ``(newspaper, file_id,
    kind, label)``, one row per comment.  Every id known to either side gets a
    row; a missing side gives empty text / zero counts.
    """
    stats = comment_stats(comment_rows, KEYS + ["kind"])
    return build_dataset_from_stats(meta_files, stats, lambda1=lambda1, threshold=threshold,
                                    with_flags=with_flags)


def build_dataset_from_stats(meta_files: DataFrame, comment_file_stats_: DataFrame, *, lambda1: float = LAMBDA,
                             threshold: float = OFFENSIVE_THRESHOLD, with_flags: bool = False) -> DataFrame:
    """R1-R6 from per-comment-file stats ``(newspaper, file_id, kind, num_comments, num_offensive_comments)``.

    Use this with the file listing of a corpus scan, where header-only and
    empty files are videos with zero comments.
    """
    meta = pick_annotated(meta_files.select(*KEYS, "kind", "title", "description", "topic"))
    meta = meta.select(*KEYS, F.col("kind").alias("meta_type"),
                       unicode_strip(F.coalesce("title", F.lit(""))).alias("title"),
                       unicode_strip(F.coalesce("description", F.lit(""))).alias("description"),
                       F.nullif(F.col("topic"), F.lit("")).alias("topic"),
                       F.lit(True).alias("_has_meta"))
    comm = pick_annotated(comment_file_stats_.select(*KEYS, "kind", "num_comments", "num_offensive_comments"))
    comm = comm.select(*KEYS, F.col("kind").alias("comm_type"), "num_comments", "num_offensive_comments",
                       F.lit(True).alias("_has_comm"))
    joined = meta.join(comm, KEYS, "full_outer")
    out = joined.select(
        F.col("file_id").alias("video_id"), "newspaper",
        F.coalesce("title", F.lit("")).alias("video_text"),
        F.coalesce("description", F.lit("")).alias("video_description"),
        F.col("topic").alias("video_topic"),
        F.coalesce("num_comments", F.lit(0)).cast("bigint").alias("num_comments"),
        F.coalesce("num_offensive_comments", F.lit(0)).cast("bigint").alias("num_offensive_comments"),
        resolve_type(F.col("meta_type"), F.col("comm_type")).alias("type"),
        F.col("_has_meta").isNotNull().alias("has_metadata"),
        F.col("_has_comm").isNotNull().alias("has_comments"))
    out = score_columns(out, lambda1=lambda1, threshold=threshold)
    cols = DATASET_COLUMNS + (["has_metadata", "has_comments"] if with_flags else [])
    return out.select(*cols)


def missing_counts(dataset_with_flags: DataFrame) -> DataFrame:
    """Videos without metadata, and with metadata but no comments."""
    return dataset_with_flags.agg(
        F.count_if(~F.col("has_metadata")).alias("videos_without_metadata"),
        F.count_if(~F.col("has_comments")).alias("videos_without_comments"))


def dataset_summary(dataset: DataFrame) -> DataFrame:
    """Videos, triggers, comments, offensive comments, mean rounded score."""
    return dataset.agg(
        F.count(F.lit(1)).alias("videos"),
        F.sum("offensive_trigger").cast("bigint").alias("triggers"),
        F.sum("num_comments").cast("bigint").alias("comments"),
        F.sum("num_offensive_comments").cast("bigint").alias("offensive_comments"),
        F.round(F.avg("offensive_score"), 4).alias("mean_offensive_score"))


def type_counts(dataset: DataFrame) -> DataFrame:
    """Videos per source tag."""
    return dataset.groupBy("type").agg(F.count(F.lit(1)).alias("videos"))
