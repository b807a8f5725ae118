"""Queries T1-T5 on events (mention threads) and conversations (reply chains)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwatch.operators import threads
from threadwatch.plans import adapters as ad
from threadwatch.plans.registry import query

SQL_NORM = "lower(rtrim(ltrim({x}, '@'), ',.:;!?'))"

SQL_PARENTS = "WITH " + ad.SQL_EVENT_COMMENTS.strip() + f""",
base AS (SELECT *, {SQL_NORM.format(x="coalesce(author, 'nan')")} AS handle FROM event_comments),
probes AS (
  SELECT video_id, comment_id, parent_comment_id, published_at,
         nullif(regexp_extract(trim(replace(replace(text, chr(160), ' '), chr(8203), '')),
                               '^\\s*@([^\\s,.:;!?]+)', 1), '') AS tok
  FROM base WHERE is_reply),
hnd AS (SELECT DISTINCT video_id, parent_comment_id, handle FROM base WHERE parent_comment_id IS NOT NULL),
tgt AS (
  SELECT p.video_id, p.comment_id, p.parent_comment_id, p.published_at, arg_max(h.handle, length(h.handle)) AS th
  FROM probes p JOIN hnd h ON p.video_id = h.video_id AND p.parent_comment_id = h.parent_comment_id
       AND starts_with({SQL_NORM.format(x="p.tok")}, h.handle)
  WHERE p.tok IS NOT NULL GROUP BY ALL),
found AS (
  SELECT t.video_id, t.comment_id, arg_max(c.comment_id, (epoch_us(c.published_at), c.comment_id)) AS fid
  FROM tgt t JOIN base c ON c.video_id = t.video_id AND c.parent_comment_id = t.parent_comment_id
       AND c.handle = t.th AND c.published_at < t.published_at
  GROUP BY ALL),
tp AS (
  SELECT b.video_id, b.comment_id, b.parent_comment_id, b.is_reply, b.text,
         coalesce(f.fid, b.parent_comment_id) AS inferred_parent_id
  FROM base b LEFT JOIN found f USING (video_id, comment_id))"""


def event_threads(spark, sf_dir):
    return threads.infer_parents(ad.event_comments(spark, sf_dir))


@query("thread_parents", SQL_PARENTS + "\nSELECT video_id, comment_id, parent_comment_id, inferred_parent_id FROM tp")
def thread_parents(spark, sf_dir):
    return event_threads(spark, sf_dir).select("video_id", "comment_id", "parent_comment_id", "inferred_parent_id")


def _sql_walk(src: str) -> str:
    return f""",
walk AS (
  SELECT video_id, comment_id AS start_id, comment_id AS cur, 0 AS d FROM {src}
  UNION ALL
  SELECT w.video_id, w.start_id, t.inferred_parent_id, w.d + 1
  FROM walk w JOIN {src} t ON t.video_id = w.video_id AND t.comment_id = w.cur WHERE t.is_reply),
depths AS (SELECT video_id, start_id AS comment_id, CAST(max(d) AS INTEGER) AS depth FROM walk GROUP BY ALL)"""


@query("thread_depth", SQL_PARENTS.replace("WITH ", "WITH RECURSIVE ", 1) + _sql_walk("tp")
       + "\nSELECT * FROM depths")
def thread_depth(spark, sf_dir):
    return threads.thread_depth(event_threads(spark, sf_dir)).select("video_id", "comment_id", "depth")


SQL_CONV = "WITH RECURSIVE " + ad.SQL_CONVERSATION_COMMENTS.strip() + """,
tc AS (SELECT *, parent_comment_id AS inferred_parent_id FROM conv_comments)"""


def conv_threads(spark, sf_dir):
    return ad.conversation_comments(spark, sf_dir).withColumn("inferred_parent_id", F.col("parent_comment_id"))


@query("thread_depth_conversations", SQL_CONV + _sql_walk("tc") + "\nSELECT * FROM depths")
def thread_depth_conversations(spark, sf_dir):
    return threads.thread_depth(conv_threads(spark, sf_dir)).select("video_id", "comment_id", "depth")


SQL_CONTEXT = SQL_CONV + _sql_walk("tc") + """,
roots AS (SELECT w.video_id, w.start_id AS comment_id, arg_max(w.cur, w.d) AS root_id FROM walk w GROUP BY ALL),
ctx AS (
  SELECT c.video_id, c.comment_id, c.text, d.depth,
         CASE WHEN d.depth >= 1 THEN r.text END AS head_comment_text,
         CASE WHEN d.depth >= 2 THEN p.text END AS previous_comment_text
  FROM tc c JOIN depths d USING (video_id, comment_id)
  JOIN roots ro USING (video_id, comment_id)
  LEFT JOIN tc r ON r.video_id = c.video_id AND r.comment_id = ro.root_id
  LEFT JOIN tc p ON p.video_id = c.video_id AND p.comment_id = c.inferred_parent_id)"""


def conv_context(spark, sf_dir):
    c = conv_threads(spark, sf_dir)
    return threads.context_columns(c, threads.thread_depth(c))


@query("thread_context", SQL_CONTEXT + """
SELECT video_id, comment_id, depth, head_comment_text, previous_comment_text FROM ctx""")
def thread_context(spark, sf_dir):
    return conv_context(spark, sf_dir).select("video_id", "comment_id", "depth", "head_comment_text",
                                              "previous_comment_text")
