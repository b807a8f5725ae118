"""The pipeline stage by stage over a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))

    def prose(n, k):
        r = random.Random(k)
        return " ".join(f"w{r.randrange(3000)}" for _ in range(n)) + "."

    passage = prose(60, 900)
    item = prose(25, 901)
    texts = {i: prose(80, i) for i in range(120)}
    labels = [(i, 1, 0) for i in range(120)]
    for i in range(120, 200):
        texts[i] = "!! ".join(w.upper() for w in prose(60, i).split())
        labels.append((i, 0, 0))
    near = texts[5].split()
    near[40] = "other"
    texts |= {300: texts[5], 301: " ".join(near), 302: prose(30, 302) + "\n" + passage, 303: prose(20, 303) + " " + passage + " " + prose(9, 304),
              304: prose(40, 305) + " " + item + " " + prose(40, 306), 305: None, 306: "", None: prose(70, 307)}
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(25, 902))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage


def test_stages(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("key", F.lit(3)) \
        .withColumn("row", F.lit("r"))
    before = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, folder))
        seen[name] = docs
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == before
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    clean = set(range(120)) | {302, 303, None}
    assert clean <= ids["quality classifier"] and not ids["quality classifier"] & set(range(120, 200))
    assert ids["quality classifier"] - ids["MinHash near-dedup"] <= {300, 301} and 5 in ids["MinHash near-dedup"]
    assert not ids["MinHash near-dedup"] & {300, 301}
    cut = {r.doc_id: r for r in seen["substring dedup"].collect()}
    assert set(cut) == ids["MinHash near-dedup"]
    assert cut[302].text == texts[302] and passage not in cut[303].text and cut[303].n_chars == len(cut[303].text)
    assert all(cut[i].text == texts[i] for i in clean - {303})
    assert ids["substring dedup"] - ids["benchmark decontamination"] == {304}
    packed = seen["best-fit packing"]
    assert {r.doc_id for r in packed.collect()} == ids["benchmark decontamination"]
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "substring dedup",
                                              "benchmark decontamination", "best-fit packing"]


def test_run_equals_the_stages(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, folder))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, pipeline.run(spark, folder).select(key).collect())) == sorted(map(str, docs.select(key).collect()))


def test_stages_of_an_empty_table(spark, corpus):
    folder, _, _ = corpus
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
