"""Evaluation (E1-E11): splits, samples, confusion counts and metric tables.

Metrics are conditional counts in one grouped aggregation (per run, model
or baseline), so the prediction table is scanned once whatever the number
of runs.  Multi-class metrics go through the (true, pred) confusion table,
whose size is bounded by the square of the number of classes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwatch.functions.fixed import SPLIT_SEED, TEST_SIZE, TRIAL_SAMPLE_SIZE
from threadwatch.functions.scoring import uniform
from threadwatch.operators.ranking import rank_within
from threadwatch.session import cut_lineage

BINARY_METRICS = ["prec_neg", "rec_neg", "f1_neg", "prec_pos", "rec_pos", "f1_pos",
                  "macro_prec", "macro_rec", "macro_f1", "weighted_f1", "accuracy"]


def _div0(a: Column, b: Column) -> Column:
    """Zero-division gives 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ------------------------------------------------------------------ splits / samples

def dev_test_split(items: DataFrame, key: str, strata: str | None = "topic", test_size: float = TEST_SIZE,
                   seed: int = SPLIT_SEED, unstratified_fallback: bool = False) -> DataFrame:
    """Adds ``split`` = dev / test; ``ceil(test_size * n)`` rows go to test.

    Stratified on ``strata``: the dev share of every stratum is the
    largest-remainder apportionment of ``n_dev`` (ties by stratum name), the
    rest of the stratum is test; a stratum of one row is apportioned like others.
    With ``unstratified_fallback`` one such stratum makes the whole split
    unstratified, as in the reference.  Within a stratum rows are ordered by the
    md5 draw of the key, so membership does not depend on partitioning.
    """
    d = items.withColumn("_u", uniform(F.col(key), seed))
    counts = cut_lineage(items.groupBy(strata).agg(F.count(F.lit(1)).alias("_c")) if strata
                         else items.agg(F.count(F.lit(1)).alias("_c")))
    n, least = counts.agg(F.sum("_c"), F.min("_c")).first()
    n = n or 0
    n_test = math.ceil(test_size * n)
    if not strata or not n or unstratified_fallback and least < 2:
        ranked = rank_within(d, F.col("_u"), [key], None, "_r")
        return ranked.withColumn("split", F.when(F.col("_r") < n_test, "test").otherwise("dev")).drop("_u", "_r")
    ranked = rank_within(d, F.col("_u"), [key], [strata], "_r")
    q = _test_quotas(counts, strata, n, n - n_test)
    j = ranked.join(q, ranked[strata].eqNullSafe(q["_stratum"]), "left")
    return j.withColumn("split", F.when(F.col("_r") < F.col("_quota"), "test").otherwise("dev")) \
            .drop("_u", "_r", "_quota", "_stratum")


def _test_quotas(counts: DataFrame, strata: str, n: int, n_dev: int) -> DataFrame:
    """``(_stratum, _quota)``: test rows of every stratum, ``largest_remainder`` over the table of counts."""
    share = F.col("_c") * F.lit(n_dev) / F.lit(n)
    parts = counts.select(F.col(strata).alias("_stratum"), "_c", F.floor(share).alias("_fl"), (share - F.floor(share)).alias("_rem"),
                          F.coalesce(F.col(strata).cast("string"), F.lit("")).alias("_name"))
    need = n_dev - parts.agg(F.sum("_fl")).first()[0]
    ranked = rank_within(parts, -F.col("_rem"), ["_name", "_stratum"], None, "_place")
    return ranked.select("_stratum", (F.col("_c") - F.col("_fl") - (F.col("_place") < need).cast("int")).alias("_quota"))


def largest_remainder(counts: dict, total: int) -> dict:
    """Apportion ``total`` over strata in proportion to ``counts`` (ties by stratum name)."""
    n = sum(counts.values())
    cont = {k: c * total / n for k, c in counts.items()}
    fl = {k: math.floor(v) for k, v in cont.items()}
    need = total - sum(fl.values())
    order = sorted(counts, key=lambda k: (-(cont[k] - fl[k]), "" if k is None else str(k)))
    for k in order[:need]:
        fl[k] += 1
    return fl


def seeded_sample(items: DataFrame, key: str, n: int | None = None, seed: int = SPLIT_SEED) -> DataFrame:
    """``min(n, rows)`` rows with the smallest md5 draws (top-k, no global sort); all rows without ``n``."""
    if n is None:
        return items
    return items.withColumn("_u", uniform(F.col(key), seed)).orderBy("_u", key).limit(n).drop("_u")


# ------------------------------------------------------------------ binary metrics

def binary_counts(pred: DataFrame, group_cols: list[str], t: str = "true_label", p: str = "pred_label") -> DataFrame:
    """Confusion counts per group; null predictions are counted and left out."""
    tt, pp = F.col(t), F.col(p)
    return pred.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(pp.isNull()).alias("n_unparseable"),
        F.count_if(tt == 1).alias("n_pos"),
        F.count_if(tt == 0).alias("n_neg"),
        F.count_if((tt == 1) & (pp == 1)).alias("tp"),
        F.count_if((tt == 0) & (pp == 1)).alias("fp"),
        F.count_if((tt == 1) & (pp == 0)).alias("fn"),
        F.count_if((tt == 0) & (pp == 0)).alias("tn"))


def binary_metrics(counts: DataFrame, group_cols: list[str]) -> DataFrame:
    """E6 + E7: the eleven metrics over labels [0, 1], zero-division 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    s1, s0 = tp + fn, tn + fp
    m = {
        "prec_neg": _div0(tn, tn + fn), "rec_neg": _div0(tn, s0), "f1_neg": _div0(2 * tn, 2 * tn + fn + fp),
        "prec_pos": _div0(tp, tp + fp), "rec_pos": _div0(tp, s1), "f1_pos": _div0(2 * tp, 2 * tp + fp + fn),
    }
    out = counts.select(*group_cols, "n_total", "n_unparseable", *[v.alias(k) for k, v in m.items()],
                        s0.alias("_s0"), s1.alias("_s1"), (tp + tn).alias("_ok"), (tp + fp + fn + tn).alias("_n"))
    return out.select(
        *group_cols, "n_total", "n_unparseable", *m.keys(),
        ((F.col("prec_neg") + F.col("prec_pos")) / 2).alias("macro_prec"),
        ((F.col("rec_neg") + F.col("rec_pos")) / 2).alias("macro_rec"),
        ((F.col("f1_neg") + F.col("f1_pos")) / 2).alias("macro_f1"),
        _div0(F.col("f1_neg") * F.col("_s0") + F.col("f1_pos") * F.col("_s1"), F.col("_s0") + F.col("_s1"))
        .alias("weighted_f1"),
        _div0(F.col("_ok"), F.col("_n")).alias("accuracy"))


def binary_score(pred: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """F1 of class 1 on parseable predictions (0 when none), with the unparseable count."""
    group_cols = group_cols or []
    c = binary_counts(pred, group_cols)
    return c.select(*group_cols, "n_total", "n_unparseable",
                    _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_offensive"))


def label_distribution(pred: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Total, positives, negatives, unparseable."""
    c = binary_counts(pred, group_cols or [])
    return c.select(*(group_cols or []), "n_total", "n_pos", "n_neg", "n_unparseable")


def mean_std(metrics: DataFrame, group_cols: list[str], metric_cols: list[str] = BINARY_METRICS) -> DataFrame:
    """Mean and population standard deviation of each metric across runs (long form)."""
    long = metrics.unpivot(group_cols + ["run"], metric_cols, "metric", "value")
    return long.groupBy(*group_cols, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("runs"))


# ------------------------------------------------------------------ multi-class

def confusion(pred: DataFrame, group_cols: list[str], t: str, p: str) -> DataFrame:
    return pred.filter(F.col(p).isNotNull()).groupBy(*group_cols, F.col(t).alias("t"), F.col(p).alias("p")) \
               .agg(F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, group_cols: list[str], t: str = "true_label", p: str = "pred_label") -> DataFrame:
    """Per class (union of labels seen in truth or prediction): tp, fp, fn, support, P, R, F1."""
    c = confusion(pred, group_cols, t, p)
    sides = c.select(*group_cols, F.explode(F.array(
        F.struct(F.col("t").cast("string").alias("label"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"),
                 F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("p").cast("string").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("bigint").alias("fn")))).alias("s")).select(*group_cols, "s.*")
    k = sides.groupBy(*group_cols, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                                 F.sum("fn").alias("fn"))
    return k.select(*group_cols, "label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"),
                    _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _div0(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def macro_f1(pred: DataFrame, group_cols: list[str] | None = None, t: str = "true_label",
             p: str = "pred_label") -> DataFrame:
    """Macro-F1 over the union of labels; unparseable predictions counted and left out."""
    group_cols = group_cols or []
    pc = per_class(pred, group_cols, t, p).groupBy(*group_cols).agg(
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))
    cnt = pred.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_total"),
                                        F.count_if(F.col(p).isNull()).alias("n_unparseable"))
    j = cnt.join(pc, group_cols, "left") if group_cols else _join_scalar(cnt, pc)
    return j.select(*group_cols, "n_total", "n_unparseable",
                    F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"),
                    F.coalesce("n_classes", F.lit(0)).cast("bigint").alias("n_classes"))


def _join_scalar(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two one-row aggregates side by side."""
    k = F.lit(1).alias("_k")
    return a.select("*", k).join(b.select("*", k), "_k", "left").drop("_k")


def _report_row(label: str, p: str, r: str, f: str) -> Column:
    return F.struct(F.lit(label).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                    F.col(f).alias("f1"), F.col("_sup").alias("support"))


def classification_report(pred: DataFrame, group_cols: list[str] | None = None, t: str = "true_label",
                          p: str = "pred_label") -> DataFrame:
    """E5: per class precision / recall / F1 / support, then accuracy, macro and weighted averages."""
    group_cols = group_cols or []
    pc = per_class(pred, group_cols, t, p)
    tot = pc.groupBy(*group_cols).agg(
        F.sum("tp").alias("_tp"), F.sum("support").alias("_sup"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        _div0(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        _div0(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        _div0(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    acc = _div0(F.col("_tp"), F.col("_sup"))
    summary = tot.select(*group_cols, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), acc.alias("f1"), F.col("_sup").alias("support")),
        _report_row("macro avg", "mp", "mr", "mf"),
        _report_row("weighted avg", "wp", "wr", "wf"))).alias("s")
    ).select(*group_cols, "s.*")
    rows = pc.select(*group_cols, "label", "precision", "recall", "f1", "support")
    return rows.unionByName(summary)
