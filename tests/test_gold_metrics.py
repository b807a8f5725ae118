"""Votes, agreement, metrics and splits on hand-made tables."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from threadwatch.operators import figures, gold, metrics


def ann_df(spark, rows):
    return spark.createDataFrame(rows, "item string, annotator string, label int")


def test_majority_label_ties_and_nulls(spark):
    rows = [("a", "A1", 1), ("a", "A2", 1), ("a", "A3", 0),      # 2-1
            ("b", "A1", 1), ("b", "A2", 0),                      # tie -> lowest
            ("c", "A1", None), ("c", "A2", 1), ("c", "A3", 0),   # null ignored, tie -> 0
            ("d", "A1", None), ("d", "A2", None)]                # all null -> null
    got = {r[0]: r[1] for r in gold.majority_label(ann_df(spark, rows), ["item"]).collect()}
    assert got == {"a": 1, "b": 0, "c": 0, "d": None}


def test_majority_topic_and_disagreements(spark):
    rows = [("v1", "A1", "sport"), ("v1", "A2", "sport"), ("v1", "A3", "health"),
            ("v2", "A1", "sport"), ("v2", "A2", "health"), ("v2", "A4", "religion")]
    df = spark.createDataFrame(rows, "item string, annotator string, topic string")
    got = {r["item"]: r["topic"] for r in gold.majority_topic(df, ["item"]).collect()}
    assert got == {"v1": "sport", "v2": None}
    dis = gold.disagreements(df, ["item"]).collect()
    assert [(r["item"], r["topics_by_annotator"]) for r in dis] == [("v2", "A1=sport; A2=health; A4=religion")]


def test_coverage_reports_missing_and_duplicates(spark):
    rows = [("f1", "A1"), ("f1", "A2"), ("f1", "A3"), ("f2", "A1"), ("f2", "A2"),
            ("f3", "A1"), ("f3", "A1"), ("f3", "A2")]
    df = spark.createDataFrame(rows, "file_id string, annotator string")
    got = {r["file_id"]: (r["n_annotations"], r["annotators"], r["duplicates"])
           for r in gold.coverage(df, ["file_id"]).collect()}
    assert got == {"f2": (2, "A1,A2", ""), "f3": (3, "A1,A1,A2", "A1")}


def cohen(a, b):
    labels = sorted(set(a) | set(b))
    n = len(a)
    po = sum(x == y for x, y in zip(a, b)) / n
    pe = sum((a.count(k) / n) * (b.count(k) / n) for k in labels)
    return None if pe == 1 else (po - pe) / (1 - pe)


def test_pairwise_kappa_matches_hand_calculation(spark):
    a1 = [1, 0, 1, 1, 0, 0, 1, 0]
    a2 = [1, 0, 0, 1, 0, 1, 1, 0]
    a3 = [1, 1, 1, 1, 1, 1, 1, 1]
    rows = []
    for i in range(8):
        rows += [(f"i{i}", "A1", a1[i]), (f"i{i}", "A2", a2[i])]
        if i < 4:
            rows.append((f"i{i}", "A3", a3[i]))
    k = {(r["a1"], r["a2"]): r["kappa"] for r in gold.pairwise_kappa(ann_df(spark, rows), ["item"]).collect()}
    assert k[("A1", "A2")] == pytest.approx(cohen(a1, a2))
    assert k[("A1", "A3")] == pytest.approx(cohen(a1[:4], a3[:4]))
    assert ("A1", "A4") not in k


def test_kappa_null_when_expected_agreement_is_one(spark):
    rows = [(f"i{i}", a, 1) for i in range(3) for a in ("A1", "A2")]
    k = gold.pairwise_kappa(ann_df(spark, rows), ["item"]).collect()
    assert k[0]["kappa"] is None


def pred_df(spark, rows):
    return spark.createDataFrame(rows, "run int, true_label int, pred_label int")


def test_binary_metrics_missing_classes(spark):
    rows = [(0, 1, 1), (0, 1, 1), (0, 1, 0),          # no negatives in truth
            (1, 0, 0), (1, 1, 0),                     # no positive prediction
            (2, 1, None), (2, 0, None)]               # all unparseable
    m = {r["run"]: r for r in metrics.binary_metrics(
        metrics.binary_counts(pred_df(spark, rows), ["run"]), ["run"]).collect()}
    assert m[0]["f1_pos"] == pytest.approx(0.8) and m[0]["prec_neg"] == 0 and m[0]["f1_neg"] == 0
    assert m[0]["macro_f1"] == pytest.approx(0.4)
    assert m[0]["weighted_f1"] == pytest.approx(0.8)
    assert m[1]["prec_pos"] == 0 and m[1]["f1_pos"] == 0 and m[1]["accuracy"] == pytest.approx(0.5)
    assert m[2]["n_unparseable"] == 2 and m[2]["accuracy"] == 0
    s = metrics.binary_score(pred_df(spark, rows).filter("run = 2")).first()
    assert s["f1_offensive"] == 0 and s["n_unparseable"] == 2


def test_mean_std_is_population_std(spark):
    df = spark.createDataFrame([("b", 0, 0.2), ("b", 1, 0.4), ("b", 2, 0.9)], "baseline string, run int, accuracy double")
    r = metrics.mean_std(df, ["baseline"], ["accuracy"]).first()
    vals = [0.2, 0.4, 0.9]
    mu = sum(vals) / 3
    assert r["mean"] == pytest.approx(mu)
    assert r["std"] == pytest.approx(math.sqrt(sum((v - mu) ** 2 for v in vals) / 3))


def test_macro_f1_union_of_labels(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", None)]
    df = spark.createDataFrame(rows, "true_label string, pred_label string")
    r = metrics.macro_f1(df).first()
    f_a = 2 * 1 / (2 * 1 + 0 + 1)
    f_b = 2 * 1 / (2 * 1 + 2 + 0)
    f_c = 0.0
    assert r["macro_f1"] == pytest.approx((f_a + f_b + f_c) / 3)
    assert r["n_unparseable"] == 1 and r["n_classes"] == 3


def test_split_sizes_and_strata(spark):
    rows = [(i, "big" if i % 3 else "small") for i in range(101)]
    df = spark.createDataFrame(rows, "k long, topic string")
    s = metrics.dev_test_split(df, "k", "topic")
    n_test = s.filter("split = 'test'").count()
    assert n_test == math.ceil(0.4 * 101)
    assert s.count() == 101
    per = {r["topic"]: r["count"] for r in s.filter("split = 'test'").groupBy("topic").count().collect()}
    assert abs(per["small"] - 0.4 * 34) < 1 and abs(per["big"] - 0.4 * 67) < 1
    # a stratum of one row forces the unstratified fallback
    one = df.unionByName(spark.createDataFrame([(999, "solo")], "k long, topic string"))
    assert metrics.dev_test_split(one, "k", "topic").filter("split = 'test'").count() == math.ceil(0.4 * 102)


def test_split_apportions_a_stratum_of_one_row(spark):
    topics = ["big" if i % 3 else "small" for i in range(101)] + ["solo"] + [None] * 5
    df = spark.createDataFrame(list(enumerate(topics)), "k long, topic string")
    counts = {t: topics.count(t) for t in set(topics)}
    quotas = metrics.largest_remainder(counts, 107 - math.ceil(0.4 * 107))
    rows = {r["k"]: r["split"] for r in metrics.dev_test_split(df, "k", "topic").collect()}
    assert {t: sum(rows[k] == "dev" for k, own in enumerate(topics) if own == t) for t in counts} == quotas
    plain = {r["k"]: r["split"] for r in metrics.dev_test_split(df, "k", None).collect()}
    back = {r["k"]: r["split"] for r in metrics.dev_test_split(df, "k", "topic", unstratified_fallback=True).collect()}
    assert back == plain != rows
    assert metrics.dev_test_split(df.limit(0), "k", "topic").count() == 0


def test_largest_remainder():
    assert metrics.largest_remainder({"a": 5, "b": 5, "c": 1}, 6) in ({"a": 3, "b": 3, "c": 0},)
    assert sum(metrics.largest_remainder({"x": 7, "y": 13, "z": 3}, 14).values()) == 14


def test_seeded_sample_is_partition_invariant(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = [r[0] for r in metrics.seeded_sample(df.repartition(1), "k", 50).collect()]
    b = [r[0] for r in metrics.seeded_sample(df.repartition(7), "k", 50).collect()]
    assert a == b and len(a) == 50


def _kappa(rows):
    n = len(rows)
    po = sum(a == b for a, b in rows) / n
    labels = {x for r in rows for x in r}
    pe = sum(sum(a == k for a, _ in rows) * sum(b == k for _, b in rows) for k in labels) / (n * n)
    return None if pe >= 1 else (po - pe) / (1 - pe)


def test_kappa_of_fifty_annotators_not_known_beforehand(spark):
    rng = random.Random(5)
    rows = [(f"i{i}", f"N{a:02d}", rng.choice(["x", "y", None] if i % 9 else ["x"]))
            for i in range(120) for a in rng.sample(range(50), 0 if i == 3 else 1 if i < 9 else 50 if i == 10 else 4)]
    rows += [("i20", "N01", "x"), ("i20", "N01", "y"), ("i21", None, "x")]
    got = {(r.a1, r.a2): (r.n_items, r.kappa) for r in gold.pairwise_kappa(
        spark.createDataFrame(rows, "item string, annotator string, label string"), ["item"]).collect()}
    votes = {}
    for i, a, v in rows:
        if a is not None and v is not None:
            votes[i, a] = max(votes.get((i, a), v), v)
    people = sorted({a for _, a in votes})
    want = {}
    for p, q in itertools.combinations(people, 2):
        both = [(votes[i, p], votes[i, q]) for i in {i for i, _ in votes} if (i, p) in votes and (i, q) in votes]
        if both:
            want[p, q] = (len(both), _kappa(both))
    assert len(people) == 50 and got.keys() == want.keys()
    for k, (n, kappa) in want.items():
        assert got[k][0] == n and (got[k][1] is None if kappa is None else got[k][1] == pytest.approx(kappa))


def test_kappa_of_chosen_annotators_and_of_none(spark):
    rows = [("i1", "A", "x"), ("i1", "B", "y"), ("i1", "C", "x"), ("i2", "A", "x"), ("i2", "C", "y")]
    df = spark.createDataFrame(rows, "item string, annotator string, label string")
    assert {(r.a1, r.a2) for r in gold.pairwise_kappa(df, ["item"], annotators=["A", "C"]).collect()} == {("A", "C")}
    assert gold.pairwise_kappa(df.filter("false"), ["item"]).count() == 0


def test_required_coverage_and_pairing_fail_with_the_files_named(spark):
    rows = [("f1", a) for a in "ABC"] + [("f2", "A"), ("f2", "A"), ("f2", "B")]
    df = spark.createDataFrame(rows, "file_id string, annotator string")
    assert gold.require_coverage(df.filter("file_id = 'f1'"), ["file_id"], 3).count() == 3
    with pytest.raises(ValueError, match="1 items .* f2: 3 by A,A,B"):
        gold.require_coverage(df, ["file_id"], 3)
    c = spark.createDataFrame([("n", "f1", "gold"), ("n", "f2", "gold"), ("m", "f1", "silver")], "newspaper string, file_id string, kind string")
    assert figures.require_pairing(c, c).count() == 2
    with pytest.raises(ValueError, match="gold n: 2 comment files, 1 metadata files, 1 matched$"):
        figures.require_pairing(c, c.filter("file_id <> 'f2'"))
