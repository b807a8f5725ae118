"""Exact row ranks without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row to one task.
Instead the rows are range-partitioned and sorted by the whole order, tie
columns included, so equal keys spread over partitions like any others.  The
sorted table is checkpointed with each row's partition and place in it; the
sizes of the partitions before are added from a table of one row a partition.
Ranks within groups are ranks in the order (group, key) less the group's first
rank, so a group of any size is spread, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwatch.session import cut_lineage

_PLACE_BITS = 33  # of monotonically_increasing_id: partition above, place in it below


def place_in_order(df: DataFrame, order: list[str | Column], n_parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, stored with ``_part`` and the ascending place ``_at``."""
    n_parts = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
                       .withColumn("_at", F.monotonically_increasing_id())
                       .withColumn("_part", F.shiftright("_at", _PLACE_BITS)))


def rank_within(df: DataFrame, order_key: Column, tie_cols: list[str], group_cols: list[str] | None = None,
                out_col: str = "rank") -> DataFrame:
    """Add ``out_col`` = 0-based position of the row inside ``group_cols`` by ``(order_key, *tie_cols)``.

    ``order_key`` may have any orderable type and is compared as it is; rows where it is
    null come last.  ``tie_cols`` must make the order total.  Every row of ``df`` is ranked;
    rows with null groups form a group.
    """
    group_cols = list(group_cols or [])
    order = [F.col(c).asc_nulls_first() for c in group_cols] + [F.col("_okey").asc_nulls_last()] + \
        [F.col(c).asc_nulls_last() for c in tie_cols]
    placed = place_in_order(df.withColumn("_okey", order_key), order).drop("_okey")
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")
                              .rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(before, F.lit(0)).alias("_off"))
    place = F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    ranked = placed.join(offsets, "_part").withColumn(out_col, place.cast("bigint")).drop("_part", "_at", "_off")
    if not group_cols:
        return ranked
    first = ranked.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group_cols]).agg(F.min(out_col).alias("_first"))
    same = [ranked[c].eqNullSafe(first[f"_g_{c}"]) for c in group_cols]
    return ranked.join(first, same).withColumn(out_col, F.col(out_col) - F.col("_first")) \
        .drop("_first", *[f"_g_{c}" for c in group_cols])
