"""Aggregates behind the figures.

All of these are grouped aggregations with map-side partial aggregation;
the only windows without ``partitionBy`` run over already-aggregated tables
whose size is bounded by the number of topics or bins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadwatch.functions.fixed import LAMBDA, SCORE_BINS, SEGMENT_LABEL_MIN_PCT, SURFACE_GRID, ZERO_BIN

FILE_KEYS = ["newspaper", "file_id", "kind"]


def pairing_check(comment_files: DataFrame, meta_files: DataFrame) -> DataFrame:
    """V1 check: per (kind, newspaper), comment files and metadata files must pair one-to-one."""
    c = comment_files.select(*FILE_KEYS).distinct().withColumn("_c", F.lit(True))
    m = meta_files.select(*FILE_KEYS).distinct().withColumn("_m", F.lit(True))
    j = c.join(m, FILE_KEYS, "full_outer")
    out = j.groupBy("kind", "newspaper").agg(
        F.count_if(F.col("_c").isNotNull()).alias("comment_files"),
        F.count_if(F.col("_m").isNotNull()).alias("metadata_files"),
        F.count_if(F.col("_c").isNotNull() & F.col("_m").isNotNull()).alias("matched"))
    return out.withColumn("one_to_one", (F.col("matched") == F.col("comment_files"))
                          & (F.col("matched") == F.col("metadata_files")))


def require_pairing(comment_files: DataFrame, meta_files: DataFrame) -> DataFrame:
    """V1, failing: the check's rows if all files pair, else a ValueError that names each group (kind and newspaper)."""
    check = pairing_check(comment_files, meta_files)
    wrong = check.filter(~F.col("one_to_one")).orderBy("kind", "newspaper").collect()  # one row a kind and newspaper
    if wrong:
        raise ValueError("files do not pair one-to-one: " + "; ".join(
            f"{r['kind']} {r['newspaper']}: {r['comment_files']} comment files, {r['metadata_files']} metadata files, "
            f"{r['matched']} matched" for r in wrong))
    return check


def join_topics(comments: DataFrame, meta_files: DataFrame) -> DataFrame:
    """V1 + V2: labelled comments of every kind with their video's topic (inner join)."""
    m = meta_files.select(*FILE_KEYS, "topic")
    return comments.join(m, FILE_KEYS, "inner")


def file_aggregates(comments: DataFrame) -> DataFrame:
    """Pre-aggregate comments per file: rows, labelled rows, label sum (map-side combined).

    Every figure statistic decomposes into these three sums, so the topic join
    runs on one row per file instead of one per comment.
    """
    return comments.groupBy(*FILE_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labelled"),
        F.sum("label").cast("bigint").alias("sum_label"))


def join_topics_agg(comments: DataFrame, meta_files: DataFrame) -> DataFrame:
    """V1 + V2 on per-file aggregates: ``(kind, newspaper, file_id, topic, n, n_labelled, sum_label)``."""
    return join_topics(file_aggregates(comments), meta_files)


def _is_agg(df: DataFrame) -> bool:
    return "n_labelled" in df.columns


def _sums(df: DataFrame):
    """(rows, labelled rows, label sum) as aggregate expressions for comment rows or file aggregates."""
    if _is_agg(df):
        return F.sum("n"), F.sum("n_labelled"), F.sum("sum_label")
    return F.count(F.lit(1)), F.count("label"), F.sum("label")


def newspaper_rates(comments: DataFrame) -> DataFrame:
    """V3: per kind, overall and per-newspaper count and offensive % (sum / rows, rounded 3).

    Accepts comment rows or ``file_aggregates`` (with topics joined).
    """
    n, _, s = _sums(comments)
    agg = comments.rollup("kind", "newspaper").agg(
        n.cast("bigint").alias("n"),
        F.round(F.coalesce(s, F.lit(0)) / n * 100, 3).alias("offensive_pct"),
        F.grouping_id().alias("_g"))
    return agg.filter(F.col("_g") < 3).select(
        "kind", F.coalesce("newspaper", F.lit("ALL")).alias("newspaper"), "n", "offensive_pct")


def topic_stats(comments: DataFrame) -> DataFrame:
    """V4: ``Total`` plus one row per non-null topic: offensive % (label mean), n, non-offensive %.

    ``Total`` counts null-topic rows; the per-topic rows drop them.
    """
    n, nl, s = _sums(comments)
    agg = comments.rollup("topic").agg(
        (F.try_divide(s.cast("double"), nl) * 100).alias("offensive"), n.cast("bigint").alias("n"),
        F.grouping_id().alias("_g"))
    agg = agg.filter((F.col("_g") == 1) | F.col("topic").isNotNull())
    return agg.select(F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col("topic")).alias("topic"),
                      "offensive", "n", (F.lit(100) - F.col("offensive")).alias("non_offensive"))


def topic_stats_by_kind(comments: DataFrame) -> DataFrame:
    """V5: total / gold / silver stats aligned on the union of topics, ``Total`` first.

    One ``cube(kind, topic)`` pass; the pivot runs on its (topics x kinds) output.
    """
    n, nl, s = _sums(comments)
    c = comments.cube("kind", "topic").agg(
        (F.try_divide(s.cast("double"), nl) * 100).alias("off"), n.cast("bigint").alias("n"),
        F.grouping_id().alias("_g"))
    # _g bit 1 = kind rolled up, bit 0 = topic rolled up
    c = c.filter(((F.col("_g") % 2) == 1) | F.col("topic").isNotNull())
    c = c.withColumn("t", F.when((F.col("_g") % 2) == 1, F.lit("Total")).otherwise(F.col("topic")))
    c = c.withColumn("k", F.when(F.col("_g") >= 2, F.lit("total")).otherwise(F.col("kind")))
    c = c.filter(F.col("k").isin("total", "gold", "silver"))
    wide = c.groupBy("t").agg(*[
        F.max(F.when(F.col("k") == k, F.col(col))).alias(f"{k}_{name}")
        for k in ("total", "gold", "silver") for col, name in (("off", "offensive"), ("n", "n"))])
    # ordinal over the aligned table: one row per topic, so the global window is bounded
    order = Window.orderBy(F.when(F.col("t") == "Total", 0).otherwise(1), "t")
    return wide.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int")) \
               .withColumnRenamed("t", "topic")


def axis_labels(comments: DataFrame) -> DataFrame:
    """V6: ``topic\\n(n=1,234)`` for every non-null topic."""
    n, _, _ = _sums(comments)
    t = comments.filter(F.col("topic").isNotNull()).groupBy("topic").agg(n.cast("bigint").alias("n"))
    return t.withColumn("axis_label", F.concat(F.col("topic"), F.lit("\n(n="),
                                               F.format_number(F.col("n"), 0), F.lit(")")))


def segment_labels(stats: DataFrame, min_pct: float = SEGMENT_LABEL_MIN_PCT) -> DataFrame:
    """V7: the offensive share is printed (one decimal) only when >= ``min_pct``; null shares are 0."""
    s = stats.filter(F.col("topic") != "Total").select(
        "topic", F.coalesce("offensive", F.lit(0.0)).alias("offensive"),
        F.coalesce("non_offensive", F.lit(0.0)).alias("non_offensive"))
    return s.withColumn("segment_label", F.when(F.col("offensive") >= min_pct,
                                                F.format_number(F.col("offensive"), 1)))


def label_shares(pred: DataFrame, topic_col: str = "video_topic") -> DataFrame:
    """V8: per topic, % of 0 and 1 among true and among predicted labels (nulls leave the denominator)."""
    p = pred.filter(F.col(topic_col).isNotNull())

    def pct(col, v):
        n = F.count_if(F.col(col) == v)
        return F.coalesce(F.try_divide(n * 100.0, F.count(F.col(col))), F.lit(None).cast("double"))
    return p.groupBy(F.col(topic_col).alias("topic")).agg(
        pct("true_label", 0).alias("true_not_trig"), pct("true_label", 1).alias("true_trig"),
        pct("pred_label", 0).alias("pred_not_trig"), pct("pred_label", 1).alias("pred_trig"))


def score_histogram(dataset: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """V9: counts of ``score*100`` in 0 / (0.0001,10] / ... / (75,100], all bins present, % of binned."""
    spark = spark or dataset.sparkSession
    r = F.col("offensive_score") * 100
    b = F.when(r == 0, F.lit(ZERO_BIN))
    for label, lo, hi in SCORE_BINS:
        b = b.when((r > lo) & (r <= hi), F.lit(label))
    counts = dataset.select(b.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").count()
    bins = spark.createDataFrame([(ZERO_BIN, 0)] + [(lab, i + 1) for i, (lab, _, _) in enumerate(SCORE_BINS)],
                                 "bin string, ordinal int")
    out = F.broadcast(bins).join(counts, "bin", "left").select(
        "bin", "ordinal", F.coalesce("count", F.lit(0)).cast("bigint").alias("videos"))
    total = F.sum("videos").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("pct", F.try_divide(F.col("videos") * 100.0, total))


def offensive_pct(dataset: DataFrame) -> DataFrame:
    """Per-video offensive % (null at zero comments), for gold and silver videos."""
    t = F.lower(F.col("type"))
    return dataset.filter(t.isin("gold", "silver")).select(
        "video_id", "newspaper", t.alias("type"), "num_offensive_comments", "offensive_score",
        F.try_divide(F.col("num_offensive_comments") * 100.0,
                     F.nullif(F.col("num_comments"), F.lit(0))).alias("offensive_pct"))


def score_surface(spark: SparkSession, max_offensive: float, grid: int = SURFACE_GRID,
                  lambda1: float = LAMBDA, threshold: float = 0.7) -> DataFrame:
    """The score on a grid x grid mesh, log-spaced count in [1, 1.5*max], linear % in [0, 100].

    Built from ``spark.range(grid*grid)`` (no cross join, no driver mesh).
    """
    top = math.log10(max_offensive * 1.5)
    g = spark.range(grid * grid).select(
        (F.col("id") % grid).alias("i"), (F.col("id") / grid).cast("bigint").alias("j"))
    n_off = F.pow(F.lit(10.0), F.col("i") * (top / (grid - 1)))
    pct = F.col("j") * (100.0 / (grid - 1))
    score = F.atan(pct / 100 + F.lit(lambda1) * F.ln(n_off)) / F.lit(math.pi / 2)
    return g.select("i", "j", n_off.alias("n_offensive"), pct.alias("pct"), score.alias("score"),
                    (score >= threshold).alias("in_region"))
