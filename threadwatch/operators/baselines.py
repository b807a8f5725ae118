"""Non-learned baselines (B1-B5) as one long prediction table.

Runs are a generator column (``explode`` of the run numbers), so every
baseline and run is produced in a single scan of the dataset; per-topic
rates and majorities are an aggregate (one row per topic) joined back.
Random draws use the md5 uniform of ``(video key, seed)``, which does not
depend on partitioning, so a recomputed task reproduces its predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadwatch.functions.fixed import BASELINE_RUNS, BASELINE_SEED, BASELINES

PRED_COLUMNS = ["baseline", "run", "video_key", "video_topic", "true_label", "pred_label"]


def _runs(df: DataFrame, n_runs: int) -> DataFrame:
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))


def _draw(seed_col):
    h = F.md5(F.concat(F.col("video_key"), F.lit(":"), seed_col.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def topic_stats(base: DataFrame, topic_col: str = "video_topic") -> DataFrame:
    """One row per topic (null topic included): rate and majority, plus the global ones.

    The global rate / majority come from a window over this per-topic table
    (one row per topic), so no scalar is collected on the driver.
    """
    t = base.groupBy(topic_col).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("true_label") == 1).alias("_n1"),
                                    F.count_if(F.col("true_label") == 0).alias("_n0"))
    every = Window.partitionBy(F.lit(1))
    t = t.withColumn("_g_rate", F.sum("_n1").over(every) / F.sum(F.col("_n1") + F.col("_n0")).over(every)) \
         .withColumn("_g_maj", F.when(F.sum("_n1").over(every) > F.sum("_n0").over(every), 1).otherwise(0))
    has_topic = F.col(topic_col).isNotNull()
    return t.select(
        topic_col, "_g_rate", "_g_maj",
        F.when(has_topic, F.col("_n1") / (F.col("_n1") + F.col("_n0"))).alias("_rate"),
        F.when(has_topic, F.when(F.col("_n1") > F.col("_n0"), 1).otherwise(0)).alias("_maj"))


def baseline_predictions(df: DataFrame, baselines: list[str] | None = None,
                         n_runs: int = BASELINE_RUNS, seed: int = BASELINE_SEED,
                         topic_col: str = "video_topic") -> DataFrame:
    """Every requested baseline and run in one long table ``PRED_COLUMNS``.

    ``df`` needs ``video_key``, ``true_label`` and (for topic baselines)
    ``video_topic``.  One scan: the per-topic statistics are joined once, then
    a generator emits one row per (baseline, run) from a fixed spec array.
    """
    specs = {b[0]: b for b in BASELINES}
    wanted = baselines or list(specs)
    needs_topic = any(specs[b][4] for b in wanted)
    if needs_topic and topic_col not in df.columns:
        raise KeyError(f"the topic baselines need the column {topic_col!r}")
    if topic_col not in df.columns:
        df = df.withColumn(topic_col, F.lit(None).cast("string"))
    base = df.select("video_key", topic_col, "true_label")
    if needs_topic:
        stats = topic_stats(base, topic_col)
        base = base.join(stats, base[topic_col].eqNullSafe(stats[topic_col]), "inner").drop(stats[topic_col])
    rate = F.coalesce(F.col("_rate"), F.col("_g_rate")) if needs_topic else F.lit(None)
    maj = F.coalesce(F.col("_maj"), F.col("_g_maj")) if needs_topic else F.lit(None)
    cases = []
    for name in wanted:
        _, kind, spec_runs, const, _ = specs[name]
        runs = n_runs if spec_runs > 1 else 1
        for run in range(runs):
            if kind == "random":
                pred = (_draw(F.lit(seed + run)) < 0.5).cast("int")
            elif kind == "topic_random":
                pred = (_draw(F.lit(seed + run)) < rate).cast("int")
            elif kind == "topic_majority":
                pred = maj.cast("int")
            else:
                pred = F.lit(const).cast("int")
            cases.append(F.struct(F.lit(name).alias("baseline"), F.lit(run).alias("run"), pred.alias("pred_label")))
    out = base.withColumn("_c", F.explode(F.array(*cases)))
    return out.select(F.col("_c.baseline").alias("baseline"), F.col("_c.run").cast("int").alias("run"),
                      "video_key", F.col(topic_col).alias("video_topic"), "true_label",
                      F.col("_c.pred_label").alias("pred_label"))
