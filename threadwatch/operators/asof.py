"""Skew-proof as-of pick: for each probe, the latest candidate strictly earlier.

A window ``partitionBy(key).orderBy(t)`` puts a hot key (one author's posts in one giant
thread) in a single task.  Here probes and candidates are scanned in one global order:

1. they are range-partitioned and sorted by ``(key, t, probes first, id)`` and stored with
   their partition and place in it, so a key, or one time of a key, of any size spreads;
2. inside a partition, a running last value gives the candidate before each probe;
3. what a partition lacks is carried over from those before it.  Only the first key of a
   partition can have begun earlier, so one row a partition is carried.

Probes sort before candidates of their own time, so only strictly earlier ones precede them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadwatch.operators.ranking import place_in_order


def asof_latest(probes: DataFrame, candidates: DataFrame, keys: list[str], t: str = "t", cid: str = "comment_id",
                n_parts: int | None = None) -> DataFrame:
    """``probes(keys.., t, cid)`` x ``candidates(keys.., t, cid)`` -> ``(keys.., cid, found_id)``.

    ``found_id`` is the ``cid`` of the candidate with the greatest ``t`` below the
    probe's ``t`` (ties on ``t`` broken by the greater ``cid``); rows without one
    are dropped.  ``t`` and ``cid`` must be orderable and non-null; null keys equal each other.
    ``n_parts`` is the number of partitions, by default that of the session's shuffles.
    """
    rows = probes.select(*keys, t, cid, F.lit(True).alias("_probe")).unionByName(
        candidates.select(*keys, t, cid, F.lit(False).alias("_probe")))
    placed = place_in_order(rows, [*keys, t, F.col("_probe").desc(), cid], n_parts)
    held = F.when(~F.col("_probe"), F.col(cid))
    before = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.last(held, ignorenulls=True).over(before)).filter("_probe")
    carried = F.broadcast(_carried(placed, keys, cid))  # at most one row a partition
    same = [local[c].eqNullSafe(carried[f"_c_{c}"]) for c in keys]
    out = local.join(carried, [local["_part"] == carried["_c_part"], *same], "left")
    found = F.coalesce("_local", "_carry")
    return out.filter(found.isNotNull()).select(*[local[c] for c in keys], local[cid], found.alias("found_id"))


def _carried(placed: DataFrame, keys: list[str], cid: str) -> DataFrame:
    """``(_c_part, _c_<key>.., _carry)``: the last candidate in earlier partitions of each partition's first key."""
    key = F.struct(*keys)
    ends = placed.groupBy("_part").agg(F.min_by(key, F.col("_at")).alias("_first"), F.max_by(key, F.col("_at")).alias("_last"))
    latest = placed.filter(~F.col("_probe")).groupBy("_part").agg(
        F.max_by(F.struct(key.alias("key"), F.col(cid).alias("id")), F.col("_at")).alias("_cand"))
    # a partition hands on its last candidate if that has the partition's last key
    ends = ends.join(latest, "_part", "left").withColumn(
        "_end", F.when(F.col("_cand.key").eqNullSafe(F.col("_last")), F.col("_cand")))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_prev", F.last("_end", ignorenulls=True).over(before))  # one row a partition
    return ends.filter(F.col("_prev").isNotNull() & F.col("_prev.key").eqNullSafe(F.col("_first"))).select(
        F.col("_part").alias("_c_part"), *[F.col(f"_first.{c}").alias(f"_c_{c}") for c in keys],
        F.col("_prev.id").alias("_carry"))
