"""Incremental comment statistics (R2) over newly landed comment files.

The original pipeline re-runs over a file tree and skips what is already
done.  Here landed comment rows (Parquet) are read as a stream with
``trigger(availableNow=True)``: each run processes only files it has not seen
(the stream checkpoint remembers them), keeps the per-file counts in the
state store, and appends the updated counts of every micro-batch to a
stats table tagged with the batch id.  ``latest_stats`` reads the newest
counts per file.  Both folders must be shared (checkpoint and output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadwatch.operators.risk import numeric_label

KEYS = ["newspaper", "file_id", "kind"]


def run_incremental_stats(spark: SparkSession, comments_dir: str, schema: StructType, out_dir: str,
                          checkpoint_dir: str) -> None:
    """Process every comment file landed since the last run, then stop."""
    stream = spark.readStream.schema(schema).parquet(comments_dir)
    counts = stream.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("num_comments"),
        F.count_if(numeric_label(F.col("label")) == 1).alias("num_offensive_comments"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_dir)

    q = (counts.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_stats(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest counts per comment file (``max_by`` over the batch id)."""
    s = spark.read.parquet(out_dir)
    return s.groupBy(*KEYS).agg(
        F.max_by("num_comments", "batch_id").alias("num_comments"),
        F.max_by("num_offensive_comments", "batch_id").alias("num_offensive_comments"))
