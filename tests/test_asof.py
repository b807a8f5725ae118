"""The as-of scan against brute force: hot keys, equal times, keys that span partitions."""

import random

import pytest

from threadwatch.operators.asof import asof_latest
from threadwatch.operators.ranking import place_in_order

SCHEMA = "k string, t long, comment_id string"


def brute(probes, cands):
    out = {}
    for k, t, pid in probes:
        best = None
        for k2, t2, cid in cands:
            if k2 == k and t2 < t and (best is None or (t2, cid) > best):
                best = (t2, cid)
        if best is not None:
            out[pid] = best[1]
    return out


def found(spark, probes, cands, n_parts):
    cdf, pdf = spark.createDataFrame(cands, SCHEMA), spark.createDataFrame(probes, SCHEMA)
    rows = asof_latest(pdf, cdf, ["k"], n_parts=n_parts).collect()
    got = {r["comment_id"]: r["found_id"] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("n_parts", [1, 4, 32])
def test_asof_matches_brute_force(spark, n_parts):
    rng = random.Random(n_parts)
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    cands = [(rng.choice(keys), rng.randint(0, 60), f"c{i:04d}") for i in range(400)]
    probes = [(rng.choice(keys + ["none"]), rng.randint(0, 60), f"p{i:04d}") for i in range(150)]
    assert found(spark, probes, cands, n_parts) == brute(probes, cands)


@pytest.mark.parametrize("n_parts", [3, 16])
def test_one_candidate_is_carried_over_partitions_of_probes_alone(spark, n_parts):
    cands = [("a", 1, "c1"), ("a", 2, "c2"), ("b", 90, "c3"), ("z", 5, "c4")]
    probes = [(k, t, f"{k}{t:03d}-{i}") for k in "abyz" for t in range(0, 100, 3) for i in range(4)]
    assert found(spark, probes, cands, n_parts) == brute(probes, cands)


def test_equal_times_of_one_key_spread_over_partitions(spark):
    cands = [("hot", 7, f"c{i:05d}") for i in range(3000)]
    probes = [("hot", 8, f"p{i:05d}") for i in range(1000)] + [("hot", 7, "same")]
    assert found(spark, probes, cands, 8) == {f"p{i:05d}": "c02999" for i in range(1000)}
    placed = place_in_order(spark.createDataFrame(cands, SCHEMA), ["k", "t", "comment_id"], 8)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_empty_sides(spark):
    some = [("a", 1, "c1")]
    nothing = spark.createDataFrame([], SCHEMA)
    df = spark.createDataFrame(some, SCHEMA)
    assert asof_latest(nothing, df, ["k"]).count() == asof_latest(df, nothing, ["k"]).count() == 0
    assert asof_latest(nothing, nothing, ["k"]).count() == 0
