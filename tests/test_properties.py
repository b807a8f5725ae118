"""Properties: partition-count invariance, idempotent cleaning, depth 0 iff top-level, monotone score."""

import os

import pytest
from pyspark.sql import functions as F

from threadwatch.functions import scoring, text
from threadwatch.operators import threads
from tools.check_oracle import normalise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", ["risk_full_outer", "split_dev_test", "pseudonymise", "thread_depth",
                                  "baseline_topic_random", "gold_majority_topic"])
def test_partition_count_invariance(spark, name):
    from __spark_entry__ import queries
    q = queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = normalise(q(spark, SF).toPandas())
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = normalise(q(spark, SF).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_clean_text_idempotent(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    once = d.select("doc_id", text.clean_text(F.col("text")).alias("t"))
    twice = once.select("doc_id", text.clean_text(F.col("t")).alias("t2"), "t")
    assert twice.filter(~F.col("t").eqNullSafe(F.col("t2"))).count() == 0


def test_depth_zero_iff_top_level(spark):
    from threadwatch.plans import adapters as ad
    c = threads.infer_parents(ad.event_comments(spark, SF))
    d = threads.thread_depth(c).join(c.select("video_id", "comment_id", "is_reply"), ["video_id", "comment_id"])
    assert d.filter((F.col("depth") == 0) != (~F.col("is_reply"))).count() == 0


def test_score_monotone_in_offensive_count(spark):
    df = spark.range(1, 200).select(F.lit(200).cast("long").alias("n"), F.col("id").alias("k"))
    s = df.select("k", scoring.offensive_score(F.col("n"), F.col("k")).alias("s")).orderBy("k").collect()
    vals = [r["s"] for r in s]
    assert all(b > a for a, b in zip(vals, vals[1:])) and all(0 < v < 1 for v in vals)
