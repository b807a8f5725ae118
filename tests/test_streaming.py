"""Incremental stats: a second run only adds what landed since the first."""

import tempfile

from threadwatch.streaming.incremental import latest_stats, run_incremental_stats

SCHEMA = "newspaper string, file_id string, kind string, label int"


def test_incremental_runs(spark):
    base = tempfile.mkdtemp(prefix="tw-stream-")
    land, out, ck = f"{base}/landed", f"{base}/stats", f"{base}/ckpt"
    first = spark.createDataFrame([("np", "v1", "silver", 1), ("np", "v1", "silver", 0), ("np", "v2", "gold", 1)],
                                  SCHEMA)
    first.write.parquet(f"{land}/part=1")
    schema = spark.read.parquet(land).schema
    run_incremental_stats(spark, land, schema, out, ck)
    got = {r["file_id"]: (r["num_comments"], r["num_offensive_comments"]) for r in latest_stats(spark, out).collect()}
    assert got == {"v1": (2, 1), "v2": (1, 1)}
    spark.createDataFrame([("np", "v1", "silver", 1), ("np", "v3", "silver", None)], SCHEMA) \
         .write.parquet(f"{land}/part=2")
    run_incremental_stats(spark, land, schema, out, ck)
    got = {r["file_id"]: (r["num_comments"], r["num_offensive_comments"]) for r in latest_stats(spark, out).collect()}
    assert got == {"v1": (3, 2), "v2": (1, 1), "v3": (1, 0)}
