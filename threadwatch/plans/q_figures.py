"""Queries V1-V10: figure aggregates over labelled comments and the video dataset."""

from __future__ import annotations

from threadwatch.functions.fixed import SCORE_BINS, ZERO_BIN
from threadwatch.operators import baselines, figures
from threadwatch.plans import adapters as ad
from threadwatch.plans.q_risk import SQL_DATASET_CTE, video_dataset
from threadwatch.plans.registry import query
from threadwatch.sources.dataset import load_dataset


def comments_with_topics(spark, sf_dir):
    """Per comment file: rows, labelled rows and label sum, with the video's topic (pre-aggregated join)."""
    return figures.join_topics_agg(ad.comment_rows(spark, sf_dir), ad.video_files(spark, sf_dir))


SQL_JOINED = f"""
WITH {ad.SQL_VIDEO_FILES.strip()},
{ad.SQL_COMMENT_ROWS.strip()},
j AS (SELECT c.kind, c.newspaper, c.file_id, c.label, m.topic
      FROM comment_rows c JOIN video_files m USING (newspaper, file_id, kind))"""


@query("pairing_check", f"""
WITH {ad.SQL_VIDEO_FILES.strip()},
{ad.SQL_COMMENT_ROWS.strip()},
c AS (SELECT DISTINCT newspaper, file_id, kind FROM comment_rows),
m AS (SELECT DISTINCT newspaper, file_id, kind FROM video_files),
f AS (SELECT coalesce(c.kind, m.kind) AS kind, coalesce(c.newspaper, m.newspaper) AS newspaper,
             c.file_id IS NOT NULL AS hc, m.file_id IS NOT NULL AS hm
      FROM c FULL OUTER JOIN m ON c.newspaper = m.newspaper AND c.file_id = m.file_id AND c.kind = m.kind)
SELECT kind, newspaper, CAST(count_if(hc) AS BIGINT) AS comment_files, CAST(count_if(hm) AS BIGINT) AS metadata_files,
       CAST(count_if(hc AND hm) AS BIGINT) AS matched,
       count_if(hc AND hm) = count_if(hc) AND count_if(hc AND hm) = CAST(count_if(hm) AS BIGINT) AS one_to_one
FROM f GROUP BY kind, newspaper""")
def pairing_check(spark, sf_dir):
    return figures.pairing_check(ad.comment_rows(spark, sf_dir), ad.video_files(spark, sf_dir))


@query("newspaper_rates", SQL_JOINED + """
SELECT kind, coalesce(newspaper, 'ALL') AS newspaper, count(*) AS n,
       round(coalesce(sum(label), 0) / count(*) * 100, 3) AS offensive_pct
FROM j GROUP BY ROLLUP (kind, newspaper) HAVING GROUPING(kind) = 0""")
def newspaper_rates(spark, sf_dir):
    return figures.newspaper_rates(comments_with_topics(spark, sf_dir))


SQL_TOPIC_STATS = SQL_JOINED + """,
stats AS (
  SELECT CASE WHEN GROUPING(topic) = 1 THEN 'Total' ELSE topic END AS topic,
         avg(label) * 100 AS offensive, count(*) AS n, 100 - avg(label) * 100 AS non_offensive
  FROM j GROUP BY ROLLUP (topic) HAVING GROUPING(topic) = 1 OR topic IS NOT NULL)"""


@query("topic_stats_total", SQL_TOPIC_STATS + "\nSELECT * FROM stats")
def topic_stats_total(spark, sf_dir):
    return figures.topic_stats(comments_with_topics(spark, sf_dir))


@query("topic_stats_by_kind", SQL_JOINED + """,
c AS (
  SELECT kind, topic, GROUPING(kind) AS gk, GROUPING(topic) AS gt, avg(label) * 100 AS off, count(*) AS n
  FROM j GROUP BY CUBE (kind, topic)),
c2 AS (
  SELECT CASE WHEN gt = 1 THEN 'Total' ELSE topic END AS t, CASE WHEN gk = 1 THEN 'total' ELSE kind END AS k, off, n
  FROM c WHERE gt = 1 OR topic IS NOT NULL),
w AS (
  SELECT t AS topic,
         max(CASE WHEN k = 'total' THEN off END) AS total_offensive, max(CASE WHEN k = 'total' THEN n END) AS total_n,
         max(CASE WHEN k = 'gold' THEN off END) AS gold_offensive, max(CASE WHEN k = 'gold' THEN n END) AS gold_n,
         max(CASE WHEN k = 'silver' THEN off END) AS silver_offensive, max(CASE WHEN k = 'silver' THEN n END) AS silver_n
  FROM c2 WHERE k IN ('total', 'gold', 'silver') GROUP BY t)
SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN topic = 'Total' THEN 0 ELSE 1 END, topic) - 1 AS INTEGER) AS ordinal
FROM w""")
def topic_stats_by_kind(spark, sf_dir):
    return figures.topic_stats_by_kind(comments_with_topics(spark, sf_dir))


@query("axis_labels", SQL_JOINED + """
SELECT topic, count(*) AS n, topic || chr(10) || '(n=' || format('{:,}', count(*)) || ')' AS axis_label
FROM j WHERE topic IS NOT NULL GROUP BY topic""")
def axis_labels(spark, sf_dir):
    return figures.axis_labels(comments_with_topics(spark, sf_dir))


@query("segment_labels", SQL_TOPIC_STATS + """
SELECT topic, coalesce(offensive, 0.0) AS offensive, coalesce(non_offensive, 0.0) AS non_offensive,
       CASE WHEN coalesce(offensive, 0.0) >= 4 THEN format('{:.1f}', coalesce(offensive, 0.0)) END AS segment_label
FROM stats WHERE topic <> 'Total'""")
def segment_labels(spark, sf_dir):
    return figures.segment_labels(figures.topic_stats(comments_with_topics(spark, sf_dir)))


def eval_dataset(spark, sf_dir):
    return load_dataset(video_dataset(spark, sf_dir), need_topic=True)


SQL_EVAL = SQL_DATASET_CTE + """,
ev AS (
  SELECT *, CAST(CAST(offensive_trigger AS DOUBLE) AS INTEGER) AS true_label, newspaper || '/' || video_id AS video_key
  FROM dataset WHERE TRY_CAST(CAST(offensive_trigger AS VARCHAR) AS DOUBLE) IS NOT NULL)"""


def sql_topic_random(run_sql_list: str = "[0, 1, 2, 3, 4]") -> str:
    # the seed is part of the hashed string: key ':' (42 + run)
    u = "(('0x' || substr(md5(video_key || ':' || CAST(42 + run AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"
    return f""",
rates AS (SELECT video_topic, avg(true_label) AS rate FROM ev WHERE video_topic IS NOT NULL GROUP BY 1),
gl AS (SELECT avg(true_label) AS g FROM ev),
runs AS (SELECT unnest({run_sql_list}) AS run),
topic_random AS (
  SELECT 'topic_majority_random' AS baseline, CAST(run AS INTEGER) AS run, video_key, ev.video_topic, true_label,
         CAST({u} < coalesce(rates.rate, gl.g) AS INTEGER) AS pred_label
  FROM ev CROSS JOIN runs CROSS JOIN gl LEFT JOIN rates ON ev.video_topic = rates.video_topic)"""


@query("label_shares_true_pred", SQL_EVAL + sql_topic_random("[0]") + """
SELECT video_topic AS topic,
       count_if(true_label = 0) * 100.0 / nullif(count(true_label), 0) AS true_not_trig,
       count_if(true_label = 1) * 100.0 / nullif(count(true_label), 0) AS true_trig,
       count_if(pred_label = 0) * 100.0 / nullif(count(pred_label), 0) AS pred_not_trig,
       count_if(pred_label = 1) * 100.0 / nullif(count(pred_label), 0) AS pred_trig
FROM topic_random WHERE video_topic IS NOT NULL GROUP BY video_topic""")
def label_shares_true_pred(spark, sf_dir):
    pred = baselines.baseline_predictions(eval_dataset(spark, sf_dir), ["topic_majority_random"], n_runs=1)
    return figures.label_shares(pred)


def _sql_bins() -> str:
    whens = " ".join(f"WHEN r > {lo} AND r <= {hi} THEN '{lab}'" for lab, lo, hi in SCORE_BINS)
    rows = ", ".join([f"('{ZERO_BIN}', 0)"] + [f"('{lab}', {i + 1})" for i, (lab, _, _) in enumerate(SCORE_BINS)])
    return whens, rows


_W, _ROWS = _sql_bins()


@query("score_histogram", SQL_DATASET_CTE + f""",
b AS (SELECT CASE WHEN r = 0 THEN '{ZERO_BIN}' {_W} END AS bin
      FROM (SELECT offensive_score * 100 AS r FROM dataset)),
cnt AS (SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin),
bins AS (SELECT * FROM (VALUES {_ROWS}) AS t(bin, ordinal))
SELECT bins.bin, CAST(bins.ordinal AS INTEGER) AS ordinal, CAST(coalesce(cnt.n, 0) AS BIGINT) AS videos,
       coalesce(cnt.n, 0) * 100.0 / sum(coalesce(cnt.n, 0)) OVER () AS pct
FROM bins LEFT JOIN cnt USING (bin)""")
def score_histogram(spark, sf_dir):
    return figures.score_histogram(video_dataset(spark, sf_dir))


@query("offensive_pct", SQL_DATASET_CTE + """
SELECT video_id, newspaper, lower(type) AS type, num_offensive_comments, offensive_score,
       num_offensive_comments * 100.0 / nullif(num_comments, 0) AS offensive_pct
FROM dataset WHERE lower(type) IN ('gold', 'silver')""")
def offensive_pct(spark, sf_dir):
    return figures.offensive_pct(video_dataset(spark, sf_dir))
