"""Python workers hold a bounded part of what long texts come in."""

from pyspark.sql import functions as F

from threadwatch.operators import annotate

LONG = 200_000


def held_bytes():
    """The factory of a predictor whose answers say how many prompts it got and by how much its worker has grown."""
    def factory():
        import resource

        def now():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * resource.getpagesize()
        start = now()
        return lambda prompts: [f"{len(prompts)} {now() - start}" for _ in prompts]
    return factory


def test_score_prompts_batches_are_bounded_by_bytes(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    n = 300  # 60 MB of prompts in one partition, fewer than the rows of one batch
    df = spark.range(0, n, 1, 1).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.repeat(F.lit("x"), LONG).alias("prompt"))
    got = annotate.score_prompts(df, ["k"], "prompt", held_bytes(), batch_size=7).collect()
    assert sorted(r["k"] or 0 for r in got) == list(range(n))
    assert sum(r["k"] is None for r in got) == 1
    rows, held = zip(*[map(int, r["raw_answer"].split()) for r in got])
    assert max(rows) <= 7
    assert max(held) < 30 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_score_and_keep_batches_are_bounded_by_bytes(spark, tmp_path):
    df = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("x"), LONG).alias("prompt"))
    answers, failures = annotate.score_and_keep(df, ["id"], "prompt", held_bytes(), str(tmp_path / "kept"))
    got = answers.collect()
    assert len(got) == 300 and failures.isEmpty()
    assert max(int(r["raw_answer"].split()[1]) for r in got) < 30 << 20


def test_nfkc_holds_few_texts_as_strings():
    import tracemalloc
    import unicodedata

    import pyarrow as pa

    from threadwatch.functions import text
    texts = ["ﬁ　①" * 2000 + str(i) for i in range(1000)] + [None, ""]
    given = pa.array(texts)
    want = pa.array([t and unicodedata.normalize("NFKC", t) for t in texts])
    tracemalloc.start()
    got = text._nfkc.func(given)  # 1,000 texts of 12 kB before and after: 2 MB of strings a slice
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.equals(want)
    assert peak < 6 << 20
    assert text._nfkc.func(given.slice(0, 0)).to_pylist() == []
