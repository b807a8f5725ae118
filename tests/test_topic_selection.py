"""The topic classifiers are compared on the reference's split."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_a_topic_of_one_video_makes_the_split_unstratified(spark, monkeypatch):
    from threadwatch.operators import metrics
    from threadwatch.plans.q_annotate import select_best_topic_model
    split, made = metrics.dev_test_split, []

    def kept(items, *a, **k):
        made.append((items, split(items, *a, **k)))
        return made[-1][1]

    monkeypatch.setattr(metrics, "dev_test_split", kept)
    assert select_best_topic_model(spark, SF).count() == 1
    (items, got), = made
    assert min(r["count"] for r in items.groupBy("topic").count().collect()) == 1
    plain = split(items, "file_id", None)
    assert sorted(map(tuple, got.select("file_id", "split").collect())) == \
        sorted(map(tuple, plain.select("file_id", "split").collect()))
