"""Queries R1-R8: the per-video risk dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwatch.functions.fixed import NEWSPAPERS
from threadwatch.functions.scoring import sql_offensive_score
from threadwatch.operators import risk
from threadwatch.plans import adapters as ad
from threadwatch.plans.registry import query
from threadwatch.sources import corpus
from threadwatch.sources.dataset import dropped_label_count, load_dataset


def lineitem_video_risk(spark, sf_dir):
    """R2 + R5 + R6 over every comment of every video (no file choice)."""
    li = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    comments = li.select(F.col("l_orderkey").cast("string").alias("video_id"),
                         ad.newspaper_of(F.col("l_orderkey")).alias("newspaper"),
                         F.when(F.col("l_returnflag") == "R", 1)
                          .when(F.col("l_returnflag") == "A", 0).cast("int").alias("label"))
    stats = risk.comment_stats(comments, ["newspaper", "video_id"])
    return risk.score_columns(stats)


SQL_VIDEO_RISK = f"""
WITH stats AS (
  SELECT {ad.sql_pick(NEWSPAPERS, 'l_orderkey')} AS newspaper, CAST(l_orderkey AS VARCHAR) AS video_id,
         count(*) AS num_comments, count(*) FILTER (WHERE l_returnflag = 'R') AS num_offensive_comments
  FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, {sql_offensive_score('num_comments', 'num_offensive_comments')} AS sc FROM stats)
SELECT newspaper, video_id, num_comments, num_offensive_comments,
       round(sc, 4) AS offensive_score, CAST(sc > 0.7 AS INTEGER) AS offensive_trigger
FROM s"""

query("video_risk_dataset", SQL_VIDEO_RISK)(lineitem_video_risk)


def video_dataset(spark, sf_dir, with_flags=False):
    return risk.build_dataset(ad.video_files(spark, sf_dir), ad.comment_rows(spark, sf_dir),
                              with_flags=with_flags)


SQL_DATASET_CTE = f"""
WITH {ad.SQL_VIDEO_FILES.strip()},
{ad.SQL_COMMENT_ROWS.strip()},
meta_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY newspaper, file_id
                               ORDER BY CASE kind WHEN 'gold' THEN 0 WHEN 'silver' THEN 1 ELSE 2 END) AS rn
  FROM video_files),
meta AS (
  SELECT newspaper, file_id, kind AS meta_type, trim(coalesce(title, ''), ' \t\n\r\x0b\x0c') AS title,
         trim(coalesce(description, ''), ' \t\n\r\x0b\x0c') AS description, nullif(topic, '') AS topic
  FROM meta_ranked WHERE rn = 1),
per_file AS (
  SELECT newspaper, file_id, kind, count(*) AS n,
         CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_off
  FROM comment_rows GROUP BY 1, 2, 3),
comm AS (
  SELECT newspaper, file_id, kind AS comm_type, n, n_off FROM (
    SELECT *, row_number() OVER (PARTITION BY newspaper, file_id
                                 ORDER BY CASE kind WHEN 'gold' THEN 0 WHEN 'silver' THEN 1 ELSE 2 END) AS rn
    FROM per_file) WHERE rn = 1),
joined AS (
  SELECT coalesce(m.newspaper, c.newspaper) AS newspaper, coalesce(m.file_id, c.file_id) AS video_id,
         coalesce(m.title, '') AS video_text, coalesce(m.description, '') AS video_description,
         m.topic AS video_topic, coalesce(c.n, 0) AS num_comments, coalesce(c.n_off, 0) AS num_offensive_comments,
         CASE WHEN m.meta_type IS NULL AND c.comm_type IS NULL THEN ''
              WHEN m.meta_type IS NULL THEN c.comm_type
              WHEN c.comm_type IS NULL OR m.meta_type = c.comm_type THEN m.meta_type
              ELSE m.meta_type || '/' || c.comm_type END AS type,
         m.file_id IS NOT NULL AS has_metadata, c.file_id IS NOT NULL AS has_comments
  FROM meta m FULL OUTER JOIN comm c ON m.newspaper = c.newspaper AND m.file_id = c.file_id),
scored AS (SELECT *, {sql_offensive_score('num_comments', 'num_offensive_comments')} AS sc FROM joined),
dataset AS (
  SELECT video_id, newspaper, video_text, video_description, video_topic, num_comments,
         num_offensive_comments, round(sc, 4) AS offensive_score, CAST(sc > 0.7 AS INTEGER) AS offensive_trigger,
         type, has_metadata, has_comments
  FROM scored)"""

DATASET_COLS = ", ".join(risk.DATASET_COLUMNS)

query("risk_full_outer", SQL_DATASET_CTE + f"\nSELECT {DATASET_COLS} FROM dataset")(video_dataset)


def all_comments(spark, sf_dir):
    """The videos' comments and those of the event threads, whose videos have no metadata file."""
    e = ad.table(spark, sf_dir, "events").select("event_id", "event_type")
    block = F.floor(F.col("event_id") / 200)
    events = e.select(
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 0).cast("int").alias("label"),
        F.concat(F.lit("v"), block.cast("string")).alias("file_id"), ad.newspaper_of(block).alias("newspaper"),
        F.lit("silver").alias("kind"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("comment_id"))
    return corpus.union_frames([ad.comment_rows(spark, sf_dir), events])


SQL_ALL_COMMENTS = f"""
all_comments AS (
  SELECT newspaper, file_id, kind, label, CAST(NULL AS VARCHAR) AS comment_id FROM comment_rows
  UNION ALL
  SELECT {ad.sql_pick(NEWSPAPERS, 'CAST(floor(event_id / 200) AS BIGINT)')}, 'v' || CAST(floor(event_id / 200) AS BIGINT), 'silver',
         CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 0 END AS INTEGER), 'c' || event_id
  FROM events)"""

SQL_ALL_CTE = SQL_DATASET_CTE.replace("FROM comment_rows GROUP BY 1, 2, 3", "FROM all_comments GROUP BY 1, 2, 3") \
    .replace("\nmeta_ranked AS", SQL_ALL_COMMENTS + ",\nmeta_ranked AS", 1)

query("union_comments", "WITH " + ad.SQL_COMMENT_ROWS.strip() + "," + SQL_ALL_COMMENTS
      + "\nSELECT newspaper, file_id, kind, label, comment_id FROM all_comments")(all_comments)


def whole_dataset(spark, sf_dir, with_flags=False):
    """R1-R6 over all comments: videos with both files, with metadata only, and with comments only."""
    return risk.build_dataset(ad.video_files(spark, sf_dir), all_comments(spark, sf_dir).drop("comment_id"), with_flags=with_flags)


query("risk_comments_only", SQL_ALL_CTE + f"\nSELECT {DATASET_COLS} FROM dataset WHERE NOT has_metadata")(
    lambda spark, sf_dir: whole_dataset(spark, sf_dir, with_flags=True).filter("not has_metadata").select(*risk.DATASET_COLUMNS))


@query("risk_missing_counts", SQL_ALL_CTE + """
SELECT CAST(count_if(NOT has_metadata) AS BIGINT) AS videos_without_metadata,
       CAST(count_if(NOT has_comments) AS BIGINT) AS videos_without_comments FROM dataset""")
def risk_missing_counts(spark, sf_dir):
    return risk.missing_counts(whole_dataset(spark, sf_dir, with_flags=True))


def reviewed_dataset(spark, sf_dir):
    """The dataset as a reviewer left it: triggers as text, ``n/a`` where no comment backs them."""
    trigger = F.when(F.col("num_comments") == 0, F.lit("n/a")).otherwise(F.col("offensive_trigger").cast("string"))
    return whole_dataset(spark, sf_dir).withColumn("offensive_trigger", trigger)


@query("typed_dataset", SQL_ALL_CTE + """
SELECT newspaper || '/' || video_id AS video_key, type, offensive_trigger AS true_label, video_topic,
       coalesce(nullif(video_text, ''), 'N/A') AS title, coalesce(nullif(video_description, ''), 'N/A') AS description
FROM dataset WHERE type = 'silver' AND num_comments > 0""")
def typed_dataset(spark, sf_dir):
    """The silver videos with a numeric label, texts filled."""
    silver = load_dataset(reviewed_dataset(spark, sf_dir), "silver", need_topic=True, need_text=True)
    return silver.select("video_key", "type", "true_label", "video_topic", "title", "description")


query("dropped_labels", SQL_ALL_CTE + "\nSELECT CAST(count_if(num_comments = 0) AS BIGINT) AS dropped FROM dataset")(
    lambda spark, sf_dir: dropped_label_count(reviewed_dataset(spark, sf_dir)))


@query("risk_type_tag", SQL_DATASET_CTE + "\nSELECT type, count(*) AS videos FROM dataset GROUP BY type")
def risk_type_tag(spark, sf_dir):
    return risk.type_counts(video_dataset(spark, sf_dir))


@query("risk_summary", SQL_DATASET_CTE + """
SELECT count(*) AS videos, CAST(sum(offensive_trigger) AS BIGINT) AS triggers,
       CAST(sum(num_comments) AS BIGINT) AS comments,
       CAST(sum(num_offensive_comments) AS BIGINT) AS offensive_comments,
       round(avg(offensive_score), 4) AS mean_offensive_score FROM dataset""")
def risk_summary(spark, sf_dir):
    return risk.dataset_summary(video_dataset(spark, sf_dir))
