"""Gold consolidation and annotator agreement.

Input is the long annotation table ``(..item keys.., annotator, label)``.
Everything is keyed by the item (never by row position).  Agreement avoids a
self-join: items with the same votes are counted together, and the pairs of
annotators are made from each distinct set of votes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwatch.functions.fixed import ANNOTATIONS_PER_ITEM, ANNOTATORS


def coverage(files: DataFrame, keys: list[str], expected: int = ANNOTATIONS_PER_ITEM) -> DataFrame:
    """G1: files without exactly ``expected`` annotations, or with a duplicate annotator."""
    per_ann = files.groupBy(*keys, "annotator").agg(F.count(F.lit(1)).alias("_n"))
    rep = per_ann.groupBy(*keys).agg(
        F.sum("_n").alias("n_annotations"),
        F.concat_ws(",", F.sort_array(F.flatten(F.collect_list(F.array_repeat("annotator", F.col("_n").cast("int"))))))
        .alias("annotators"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("_n") > 1, F.col("annotator"))))).alias("duplicates"))
    return rep.filter((F.col("n_annotations") != expected) | (F.col("duplicates") != ""))


def require_coverage(files: DataFrame, keys: list[str], expected: int = ANNOTATIONS_PER_ITEM, shown: int = 5) -> DataFrame:
    """G1, failing: ``files`` itself if ``coverage`` finds nothing, else a ValueError that counts and names some files."""
    wrong = coverage(files, keys, expected)
    some = wrong.orderBy(*keys).limit(shown).collect()
    if some:
        named = "; ".join(f"{'/'.join(str(r[k]) for k in keys)}: {r['n_annotations']} by {r['annotators']}" for r in some)
        raise ValueError(f"{wrong.count()} items without exactly {expected} annotations by different annotators: {named}")
    return files


def majority_label(ann: DataFrame, item_keys: list[str], label: str = "label") -> DataFrame:
    """Modal label per item, nulls ignored, lowest value on a tie."""
    return ann.groupBy(*item_keys).agg(F.mode(label, True).alias(label))


def _topic_votes(ann: DataFrame, keys: list[str], topic: str) -> DataFrame:
    votes = ann.groupBy(*keys, topic).agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(*keys).agg(
        F.min_by(F.col(topic), F.struct((-F.col("_n")).alias("n"), F.col(topic).alias("t"))).alias("_top"),
        F.max("_n").alias("_max"), F.sum("_n").alias("n_annotations"))


def majority_topic(ann: DataFrame, keys: list[str], topic: str = "topic") -> DataFrame:
    """The topic most annotators gave; null when no value has two votes."""
    v = _topic_votes(ann, keys, topic)
    return v.select(*keys, F.when(F.col("_max") > 1, F.col("_top")).alias(topic), "n_annotations")


def topics_by_annotator(ann: DataFrame, keys: list[str], topic: str = "topic") -> DataFrame:
    """Report string ``A1=t1; A3=t3`` per item (null topics shown as ``None``)."""
    entry = F.concat(F.col("annotator"), F.lit("="), F.coalesce(F.col(topic), F.lit("None")))
    return ann.groupBy(*keys).agg(F.concat_ws("; ", F.sort_array(F.collect_list(entry))).alias("topics_by_annotator"))


def disagreements(ann: DataFrame, keys: list[str], topic: str = "topic") -> DataFrame:
    """Items whose annotators all disagree, with their topics by annotator."""
    v = _topic_votes(ann, keys, topic).filter(F.col("_max") == 1).select(*keys)
    return v.join(topics_by_annotator(ann, keys, topic), keys)


def gold_rows(ann: DataFrame, item_keys: list[str], label: str = "label") -> DataFrame:
    """The first annotator's row per item with the majority label and ``type='gold'``."""
    payload = [c for c in ann.columns if c not in item_keys and c != label]
    agg = ann.groupBy(*item_keys).agg(
        F.min_by(F.struct(*payload), F.col("annotator")).alias("_b"), F.mode(label, True).alias(label))
    return agg.select(*item_keys, "_b.*", label).withColumn("type", F.lit("gold"))


def label_matrix(ann: DataFrame, item_keys: list[str], label: str = "label",
                 annotators: list[str] = ANNOTATORS) -> DataFrame:
    """One column per annotator, null where the annotator had no such item."""
    return ann.groupBy(*item_keys).pivot("annotator", annotators).agg(F.max(label))


def _pair_cells(ann: DataFrame, item_keys: list[str], label: str) -> DataFrame:
    """``(a1, a2, l1, l2, n)``: how many items annotators ``a1 < a2`` labelled ``l1`` and ``l2``.

    Items with the same votes are counted first, so pairs are made once for each distinct
    set of votes.  The two sides unfold one after the other: no row holds all pairs.
    """
    votes = ann.groupBy(*item_keys, "annotator").agg(F.max(F.col(label).cast("string")).alias("l")) \
        .filter(F.col("annotator").isNotNull() & F.col("l").isNotNull())
    by_item = votes.groupBy(*item_keys).agg(F.sort_array(F.collect_list(F.struct(F.col("annotator").alias("a"), "l"))).alias("v"))
    patterns = by_item.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    firsts = patterns.select("n", "v", F.posexplode("v").alias("at", "x"))
    pairs = firsts.select("n", "x", F.explode(F.slice("v", F.col("at") + 2, F.size("v"))).alias("y"))
    return pairs.groupBy(F.col("x.a").alias("a1"), F.col("y.a").alias("a2"), F.col("x.l").alias("l1"),
                         F.col("y.l").alias("l2")).agg(F.sum("n").alias("n"))


def pairwise_kappa(ann: DataFrame, item_keys: list[str], label: str = "label",
                   annotators: list[str] | None = None) -> DataFrame:
    """Cohen's kappa per annotator pair (``a1 < a2``) over items both labelled.

    All annotators found count, however many, or only ``annotators``.  Of several labels of
    one annotator for one item the greatest counts.  A pair that shares no item has no row;
    kappa is null when the expected agreement is 1.
    """
    if annotators is not None:
        ann = ann.filter(F.col("annotator").isin(annotators))
    cells = _pair_cells(ann, item_keys, label)
    tot = cells.groupBy("a1", "a2").agg(F.sum("n").alias("N"),
                                        F.sum(F.when(F.col("l1") == F.col("l2"), F.col("n")).otherwise(0)).alias("agree"))
    m1 = cells.groupBy("a1", "a2", F.col("l1").alias("k")).agg(F.sum("n").alias("n1"))
    m2 = cells.groupBy("a1", "a2", F.col("l2").alias("k")).agg(F.sum("n").alias("n2"))
    marg = m1.join(m2, ["a1", "a2", "k"], "inner").groupBy("a1", "a2").agg(F.sum(F.col("n1") * F.col("n2")).alias("pp"))
    k = tot.join(marg, ["a1", "a2"], "left").select(
        "a1", "a2", F.col("N").alias("n_items"),
        (F.col("agree") / F.col("N")).alias("po"),
        (F.coalesce(F.col("pp"), F.lit(0)) / (F.col("N") * F.col("N"))).alias("pe"))
    k = k.withColumn("kappa", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))
    return k.select("a1", "a2", "n_items", "kappa")


def mean_kappa(kappas: DataFrame) -> DataFrame:
    """Unweighted mean over pairs (pairs without a kappa are left out)."""
    return kappas.agg(F.avg("kappa").alias("mean_kappa"), F.count("kappa").alias("pairs"))


def category_counts(ann: DataFrame, item_keys: list[str], topic: str = "topic") -> DataFrame:
    """Item x category vote counts, in sparse long form (zero cells omitted)."""
    return ann.filter(F.col(topic).isNotNull()).groupBy(*item_keys, F.col(topic).alias("category")) \
              .agg(F.count(F.lit(1)).alias("n"))
