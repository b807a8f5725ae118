"""Queries S9 and I2: per-video comment files as CSV lines, comments stored by newspaper."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwatch.functions.fixed import NEWSPAPERS
from threadwatch.operators import collection
from threadwatch.plans import adapters as ad
from threadwatch.plans.registry import query
from threadwatch.session import cut_lineage
from threadwatch.sources import sinks

COLUMNS = ["comment_id", "text", "label"]
OLDER = ["label", "text", "comment_id"]  # the order of columns in the files of pending orders
WANTED = ["lastampa", "repubblica"]


@query("comment_csv_lines", f"""
WITH files AS (SELECT DISTINCT {ad.sql_pick(NEWSPAPERS, 'o_orderkey')} AS newspaper, o_orderkey AS k, o_orderstatus = 'P' AS older FROM orders),
rows AS (SELECT l_orderkey AS k, l_linenumber AS line_no, CAST(l_partkey AS VARCHAR) AS id,
                '"flag ""' || l_returnflag || '"", ' || l_linestatus || '"' AS txt,
                CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN '0' ELSE '' END AS label FROM lineitem)
SELECT newspaper, CAST(k AS VARCHAR) AS file_id, CAST(0 AS BIGINT) AS line_no,
       CASE WHEN older THEN 'text,comment_id,label' ELSE 'comment_id,text,label' END AS line FROM files
UNION ALL
SELECT newspaper, CAST(k AS VARCHAR), CAST(line_no AS BIGINT) + 1,
       CASE WHEN older THEN txt || ',' || id ELSE id || ',' || txt END || ',' || label
FROM rows JOIN files USING (k)""")
def comment_csv_lines(spark, sf_dir):
    """The lines of every video's comment file, label last; videos without comments have a header only."""
    li = ad.table(spark, sf_dir, "lineitem")
    rows = li.select(
        ad.newspaper_of(F.col("l_orderkey")).alias("newspaper"), F.col("l_orderkey").cast("string").alias("file_id"),
        F.col("l_linenumber").alias("row_no"), F.col("l_partkey").alias("comment_id"),
        F.concat(F.lit('flag "'), "l_returnflag", F.lit('", '), "l_linestatus").alias("text"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("label"))
    older = F.when(F.col("o_orderstatus") == "P", F.array(*[F.lit(c) for c in OLDER]))
    files = ad.table(spark, sf_dir, "orders").select(
        ad.newspaper_of(F.col("o_orderkey")).alias("newspaper"), F.col("o_orderkey").cast("string").alias("file_id"),
        older.alias("header"))
    return sinks.csv_lines(rows, files, COLUMNS)


@query("newspaper_comments", "WITH " + ad.SQL_COMMENT_ROWS.strip() + f"""
SELECT file_id, kind, label, newspaper FROM comment_rows WHERE newspaper IN ({", ".join("'" + n + "'" for n in WANTED)})""")
def newspaper_comments(spark, sf_dir):
    """Comments stored in folders by newspaper, of which only those of the wanted newspapers are read."""
    stored = cut_lineage(ad.comment_rows(spark, sf_dir), ("newspaper",))
    return collection.newspaper_filter(stored, ",".join(WANTED)).select("file_id", "kind", "label", "newspaper")
