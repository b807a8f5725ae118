"""The comment annotation job hands its workers a bounded part of the prompts, which hold whole documents."""

from pyspark.sql import functions as F

from threadwatch.operators import annotate, lexicon
from threadwatch.plans import q_annotate

LONG = 200_000


def test_comment_prompts_reach_python_in_bounded_batches(spark, tmp_path, monkeypatch):
    n = 300  # one comment a document: 60 MB of prompts, fewer than the rows of one batch
    docs = spark.range(n + 20).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("title").alias("source"),
                                      F.repeat(F.lit("x"), F.when(F.col("id") < n, LONG).otherwise(5)).alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n, n + 20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"),
                                  (F.col("id") % 2).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(n + 2).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"),
                              F.lit("you clown").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")

    class Held:
        """Answers by how much its worker has grown since it was made in it."""

        def __init__(self, *_):
            self.start = None

        def now(self):
            import resource
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * resource.getpagesize()

        def __setstate__(self, state):
            import pandas  # noqa: F401 - whatever a worker loads once
            import pyarrow
            pyarrow.array(["x"]).to_pylist()
            self.start = self.now()

        def __getstate__(self):
            return {"start": None, "sent": True}

        def __call__(self, prompts):
            return [f"{len(p)} {self.now() - self.start}" for p in prompts]

    monkeypatch.setattr(lexicon, "FittedRule", Held)
    monkeypatch.setattr(annotate, "attach_silver_label", lambda items: items)
    statuses, answered = q_annotate.silver_comments(spark, str(tmp_path))
    got = answered.collect()
    assert sorted(r.video_id for r in got) == sorted(f"conv{i}" for i in range(n))
    assert {r.status: r.n for r in annotate.run_counters(statuses).collect()} == {"pending": n, "skipped_gold": 1, "skipped_silver": 1}
    chars, held = zip(*[map(int, r.raw_answer.split()) for r in got])
    assert min(chars) > LONG
    assert max(held) < 30 << 20
