"""Intermediate tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwatch.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage and survives lost executors; compressed, unlike ``checkpoint()``.
    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``: the smallest node it is connected with.

    Each round maps every node to its smallest neighbour and contracts the graph; the
    rounds needed grow with the logarithm of a path's length.  Only aggregates by node
    and equi-joins: no component is ever gathered in one task.
    """
    spark = edges.sparkSession
    left = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        step = stored(ends.groupBy("node").agg(F.min("other").alias("m"))
                      .select("node", F.least("node", "m").alias("root")))
        if roots is None:
            roots = step
        else:
            nxt = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            roots = roots.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        moved = left.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a") \
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b") \
            .filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = stored(moved)
        if left.isEmpty():
            return stored(roots)


def empty_like(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
