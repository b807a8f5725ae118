"""Queries G1-G8 on the annotators' workload built from documents x labels."""

from __future__ import annotations

from itertools import combinations

from threadwatch.functions.fixed import ANNOTATORS
from threadwatch.operators import gold
from threadwatch.plans import adapters as ad
from threadwatch.plans.registry import query

FILE = ["newspaper", "file_id"]


@query("gold_coverage", "WITH " + ad.SQL_ANNOTATION_FILES.strip() + """,
pa AS (SELECT newspaper, file_id, annotator, count(*) AS n FROM annotation_files GROUP BY ALL),
rep AS (
  SELECT newspaper, file_id, CAST(sum(n) AS BIGINT) AS n_annotations,
         array_to_string(list_sort(flatten(list(repeat([annotator], CAST(n AS INTEGER))))), ',') AS annotators,
         coalesce(array_to_string(list_sort(list(annotator) FILTER (WHERE n > 1)), ','), '') AS duplicates
  FROM pa GROUP BY newspaper, file_id)
SELECT * FROM rep WHERE n_annotations <> 3 OR duplicates <> ''""")
def gold_coverage(spark, sf_dir):
    return gold.coverage(ad.annotation_files(spark, sf_dir), FILE)


SQL_CA = "WITH " + ad.SQL_COMMENT_ANNOTATIONS.strip()


@query("gold_majority_label", SQL_CA + """
SELECT comment_id, label FROM (
  SELECT comment_id, label, row_number() OVER (PARTITION BY comment_id ORDER BY n DESC, label) AS r
  FROM (SELECT comment_id, label, count(label) AS n FROM comment_annotations GROUP BY ALL)) WHERE r = 1""")
def gold_majority_label(spark, sf_dir):
    return gold.majority_label(ad.comment_annotations(spark, sf_dir), ["comment_id"])


SQL_TOPIC_VOTES = """,
tv AS (SELECT newspaper, file_id, topic, count(*) AS n FROM topic_annotations GROUP BY ALL),
tvr AS (SELECT *, row_number() OVER (PARTITION BY newspaper, file_id ORDER BY n DESC, topic NULLS FIRST) AS r,
               max(n) OVER (PARTITION BY newspaper, file_id) AS mx,
               sum(n) OVER (PARTITION BY newspaper, file_id) AS tot
        FROM tv)"""


@query("gold_majority_topic", "WITH " + ad.sql_topic_annotations().strip() + SQL_TOPIC_VOTES + """
SELECT newspaper, file_id, CASE WHEN mx > 1 THEN topic END AS topic, CAST(tot AS BIGINT) AS n_annotations
FROM tvr WHERE r = 1""")
def gold_majority_topic(spark, sf_dir):
    return gold.majority_topic(ad.topic_annotations(spark, sf_dir), FILE)


@query("disagreements", "WITH " + ad.sql_topic_annotations().strip() + SQL_TOPIC_VOTES + """,
rep AS (SELECT newspaper, file_id,
               array_to_string(list_sort(list(annotator || '=' || coalesce(topic, 'None'))), '; ') AS topics_by_annotator
        FROM topic_annotations GROUP BY ALL)
SELECT rep.* FROM tvr JOIN rep USING (newspaper, file_id) WHERE r = 1 AND mx = 1""")
def disagreements(spark, sf_dir):
    return gold.disagreements(ad.topic_annotations(spark, sf_dir), FILE)


@query("gold_rows", SQL_CA + """,
maj AS (SELECT comment_id, label FROM (
  SELECT comment_id, label, row_number() OVER (PARTITION BY comment_id ORDER BY n DESC, label) AS r
  FROM (SELECT comment_id, label, count(label) AS n FROM comment_annotations GROUP BY ALL)) WHERE r = 1),
base AS (SELECT comment_id, arg_min(newspaper, annotator) AS newspaper, arg_min(file_id, annotator) AS file_id,
                min(annotator) AS annotator, arg_min(text, annotator) AS text
         FROM comment_annotations GROUP BY comment_id)
SELECT base.comment_id, base.newspaper, base.file_id, base.annotator, base.text, maj.label, 'gold' AS type
FROM base JOIN maj USING (comment_id)""")
def gold_rows(spark, sf_dir):
    a = ad.comment_annotations(spark, sf_dir)
    return gold.gold_rows(a, ["comment_id"])


_PIVOT = ", ".join(f"max(label) FILTER (WHERE annotator = '{a}') AS {a}" for a in ANNOTATORS)


@query("label_matrix", SQL_CA + f"\nSELECT comment_id, {_PIVOT} FROM comment_annotations GROUP BY comment_id")
def label_matrix(spark, sf_dir):
    return gold.label_matrix(ad.comment_annotations(spark, sf_dir), ["comment_id"])


def _sql_kappa(src: str, item: str, label: str) -> str:
    piv = ", ".join(f"max(CAST({label} AS VARCHAR)) FILTER (WHERE annotator = '{a}') AS {a}" for a in ANNOTATORS)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a1, '{b}' AS a2, {a} AS l1, {b} AS l2 FROM mtx"
                               for a, b in combinations(ANNOTATORS, 2))
    return f""",
mtx AS (SELECT {item}, {piv} FROM {src} GROUP BY {item}),
lng AS (SELECT * FROM ({pairs}) WHERE l1 IS NOT NULL AND l2 IS NOT NULL),
cells AS (SELECT a1, a2, l1, l2, count(*) AS n FROM lng GROUP BY ALL),
tot AS (SELECT a1, a2, sum(n) AS nn, sum(CASE WHEN l1 = l2 THEN n ELSE 0 END) AS agree FROM cells GROUP BY ALL),
m1 AS (SELECT a1, a2, l1 AS k, sum(n) AS n1 FROM cells GROUP BY ALL),
m2 AS (SELECT a1, a2, l2 AS k, sum(n) AS n2 FROM cells GROUP BY ALL),
marg AS (SELECT a1, a2, sum(n1 * n2) AS pp FROM m1 JOIN m2 USING (a1, a2, k) GROUP BY ALL),
kp AS (SELECT a1, a2, CAST(nn AS BIGINT) AS n_items, agree / nn AS po, coalesce(pp, 0) / (nn * nn) AS pe
       FROM tot LEFT JOIN marg USING (a1, a2))
SELECT a1, a2, n_items, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM kp"""


query("pairwise_kappa", SQL_CA + _sql_kappa("comment_annotations", "comment_id", "label"))(
    lambda spark, sf_dir: gold.pairwise_kappa(ad.comment_annotations(spark, sf_dir), ["comment_id"]))
query("pairwise_kappa_topics", "WITH " + ad.sql_topic_annotations().strip()
      + _sql_kappa("topic_annotations", "newspaper, file_id", "topic"))(
    lambda spark, sf_dir: gold.pairwise_kappa(ad.topic_annotations(spark, sf_dir), FILE, "topic"))


@query("mean_kappa", SQL_CA + _sql_kappa("comment_annotations", "comment_id", "label").replace(
    "SELECT a1, a2, n_items, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM kp",
    ", kk AS (SELECT CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM kp)\n"
    "SELECT avg(kappa) AS mean_kappa, count(kappa) AS pairs FROM kk"))
def mean_kappa(spark, sf_dir):
    return gold.mean_kappa(gold.pairwise_kappa(ad.comment_annotations(spark, sf_dir), ["comment_id"]))


@query("category_counts", "WITH " + ad.sql_topic_annotations().strip() + """
SELECT newspaper, file_id, topic AS category, count(*) AS n FROM topic_annotations
WHERE topic IS NOT NULL GROUP BY ALL""")
def category_counts(spark, sf_dir):
    return gold.category_counts(ad.topic_annotations(spark, sf_dir), FILE)
