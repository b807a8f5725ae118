"""Annotation jobs (A1-A4, A8-A10): pending sets, batched scoring, silver labels.

The classifier is a plug-in: a *predictor factory* is shipped to the
executors and called once per task inside ``mapInArrow``; it receives lists
of at most ``batch_size`` prompts and returns one raw answer per prompt.  Only
those are Python strings at a time; keys pass through as they came.
Results are keyed, so there is no positional scatter back to files, and the
scored table is checkpointed to the shared folder so that a second action
(or a lost executor) never re-runs the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwatch.functions.fixed import INFERENCE_BATCH_SIZE, MAX_NEW_TOKENS, MODELS
from threadwatch.functions.text import unicode_strip
from threadwatch.session import cut_lineage, small_arrow_batches

Predictor = Callable[[list[str]], list[str]]


def pending(raw: DataFrame, gold: DataFrame, silver: DataFrame, keys: list[str],
            overwrite: bool = False) -> DataFrame:
    """A1: raw items without a gold annotation, and without a silver one unless ``overwrite``."""
    p = raw.join(gold.select(*keys).distinct(), keys, "left_anti")
    if not overwrite:
        p = p.join(silver.select(*keys).distinct(), keys, "left_anti")
    return p


def status_table(raw: DataFrame, gold: DataFrame, silver: DataFrame, keys: list[str], text_col: str,
                 overwrite: bool = False) -> DataFrame:
    """Per raw item: ``skipped_gold`` / ``skipped_silver`` / ``skipped_empty`` / ``pending``."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(True))
    s = silver.select(*keys).distinct().withColumn("_s", F.lit(True))
    t = raw.join(g, keys, "left").join(s, keys, "left")
    st = (F.when(F.col("_g").isNotNull(), "skipped_gold")
          .when(F.col("_s").isNotNull() & F.lit(not overwrite), "skipped_silver")
          .when(F.col(text_col).isNull() | (F.col(text_col) == ""), "skipped_empty")
          .otherwise("pending"))
    return t.withColumn("status", st).drop("_g", "_s")


def run_counters(statuses: DataFrame) -> DataFrame:
    """A2: one count per status."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def model_catalogue(spark: SparkSession) -> DataFrame:
    """A4: the model catalogue as a small dimension table."""
    return spark.createDataFrame([(k, n, s, MAX_NEW_TOKENS, i) for i, (k, n, s) in enumerate(MODELS)],
                                 "model_key string, name string, supports_system_role boolean, "
                                 "max_new_tokens int, ordinal int")


def _in_batches(batches: Iterator[pa.RecordBatch], key_cols: list[str], prompt_col: str, batch_size: int,
                ask: Callable[[list[str]], list[tuple]], outcome: list[str]) -> Iterator[pa.RecordBatch]:
    """The keys of every row and the strings of ``outcome`` that ``ask`` gives for its prompt, ``batch_size`` prompts at a time."""
    for batch in batches:
        prompts = batch.column(prompt_col)
        got = [x for i in range(0, batch.num_rows, batch_size) for x in ask(prompts.slice(i, batch_size).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in key_cols]
                                         + [pa.array([x[i] for x in got], pa.string()) for i in range(len(outcome))],
                                         names=[*key_cols, *outcome])


def score_prompts(df: DataFrame, key_cols: list[str], prompt_col: str,
                  predictor_factory: Callable[[], Predictor], batch_size: int = INFERENCE_BATCH_SIZE,
                  checkpoint: bool = True) -> DataFrame:
    """A3: ``(keys..., raw_answer)`` for every prompt, in batches of ``batch_size``.

    The factory runs once per task (e.g. loads a model onto the executor's
    device); rows are pooled across files by construction, so batches are full.
    """
    from threadwatch.session import ship_package
    ship_package(df.sparkSession)
    schema = df.select(*key_cols).schema.add("raw_answer", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor_factory()

        def ask(prompts: list[str]) -> list[tuple[str]]:
            answers = predict(prompts)
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return [(a,) for a in answers]

        return _in_batches(batches, key_cols, prompt_col, batch_size, ask, ["raw_answer"])

    scored = df.select(*key_cols, prompt_col).mapInArrow(run, schema)
    if not checkpoint:
        return scored
    with small_arrow_batches(df.sparkSession):
        return cut_lineage(scored)


def score_and_keep(df: DataFrame, key_cols: list[str], prompt_col: str, predictor_factory: Callable[[], Predictor], path: str,
                   *, slices: int = 1, batch_size: int = INFERENCE_BATCH_SIZE) -> tuple[DataFrame, DataFrame]:
    """A3 for long runs: ``(answers, failures)`` with every outcome kept under ``path``, so that a run can be resumed.

    Prompts that have an answer under ``path`` are not asked again; the others are scored in
    ``slices`` jobs, each committed as a table of its own, so a run that is cut short loses
    at most one slice.  When the predictor fails on a batch, its prompts are asked one by
    one; those that still fail are failures with the error's text, and a later run asks them
    again.  ``answers`` has the keys and ``raw_answer``, ``failures`` the keys and ``error``
    of what has no answer yet.  Keys must identify the prompts; null keys are keys like others.
    """
    from threadwatch.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    schema = df.select(*key_cols).schema.add("raw_answer", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor_factory()

        def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                answers = predict(prompts)
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
                return [(a, None) for a in answers]
            except Exception as e:  # noqa: BLE001 - whatever a model raises is an outcome of these prompts
                if len(prompts) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
                return [ask([p])[0] for p in prompts]

        return _in_batches(batches, key_cols, prompt_col, batch_size, ask, ["raw_answer", "error"])

    def kept() -> DataFrame:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [str(s.getPath()) for s in fs.listStatus(place)] if fs.exists(place) else []
        done = [p for p in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS"))]
        return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)

    def missing(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)]).distinct()
        same = [left[c].eqNullSafe(right[f"_k{i}"]) for i, c in enumerate(key_cols)]
        return left.join(right, same, "left_anti")

    before = kept().filter("error is null")
    todo = missing(df.select(*key_cols, prompt_col), before)
    for i in range(slices):
        part = todo.filter(F.pmod(F.xxhash64(*key_cols), F.lit(slices)) == i)
        with small_arrow_batches(spark):
            part.mapInArrow(run, schema).write.parquet(f"{path}/slice-{uuid.uuid4().hex}")
    outcomes = kept()
    answers = outcomes.filter("error is null").drop("error").dropDuplicates(key_cols)
    failures = missing(outcomes.filter("error is not null"), answers).groupBy(*key_cols).agg(F.max("error").alias("error"))
    return answers, failures


def attach_silver_topic(items: DataFrame, parsed_topic: str = "parsed_topic") -> DataFrame:
    """A8 (videos): unparseable topic is stored as the empty string."""
    return items.withColumn("topic", F.coalesce(F.col(parsed_topic), F.lit("")))


def attach_silver_label(items: DataFrame, answer: str = "raw_answer") -> DataFrame:
    """A8 (comments): the parsed ``label`` (null if unparseable) after the columns that were there."""
    from threadwatch.functions.text import parse_label
    return items.withColumn("label", parse_label(F.col(answer))).drop(answer)


def annotation_counters(statuses: DataFrame, labelled: DataFrame, label_col: str, unparseable_value=None) -> DataFrame:
    """A2 for a whole run: ``outcome_counters`` and ``errors``, the pending items that got no answer row."""
    out = outcome_counters(statuses, labelled, label_col, unparseable_value)
    asked = statuses.filter(F.col("status") == "pending").agg(F.count(F.lit(1)).alias("asked"))
    got = labelled.agg(F.count(F.lit(1)).alias("got"))
    errors = asked.join(got).select(F.lit("errors").alias("status"), (F.col("asked") - F.col("got")).alias("n"))
    return out.unionByName(errors)


def attach_metadata(comments: DataFrame, meta: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Title and description onto comments; missing metadata gives empty strings.

    ``strict`` (gold) raises when any comment's video has no metadata.
    """
    m = meta.select(*keys, "title", "description")
    if strict:
        missing = comments.select(*keys).distinct().join(m, keys, "left_anti").limit(1).count()
        if missing:
            raise ValueError("metadata file not found for some gold comments")
    j = comments.join(m, keys, "left")
    return j.withColumn("title", F.coalesce("title", F.lit(""))) \
            .withColumn("description", F.coalesce("description", F.lit("")))


def gold_videos(videos: DataFrame, topic_col: str = "topic") -> DataFrame:
    """A10: drop null / blank topics, keep ``topic_raw``, add the canonical ``topic``.

    Raises if no video has a topic; ``dropped_topics`` counts those without.
    """
    from threadwatch.functions.taxonomy import canonical_topic
    v = videos.filter(~_no_topic(topic_col))
    if v.isEmpty():
        raise ValueError("no gold video has a topic")
    return v.withColumnRenamed(topic_col, "topic_raw").withColumn("topic", canonical_topic(F.col("topic_raw")))


def _no_topic(topic_col: str):
    return F.col(topic_col).isNull() | (unicode_strip(F.col(topic_col)) == "")


def dropped_topics(videos: DataFrame, topic_col: str = "topic") -> DataFrame:
    """A10: how many videos ``gold_videos`` keeps and drops."""
    return videos.agg(F.count_if(~_no_topic(topic_col)).alias("kept"), F.count_if(_no_topic(topic_col)).alias("dropped"))


def outcome_counters(statuses: DataFrame, labelled: DataFrame, label_col: str, unparseable_value=None) -> DataFrame:
    """A2 after scoring: skipped counts plus ``written`` and ``unparseable`` (a subset of written)."""
    skips = statuses.filter(F.col("status").startswith("skipped_")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))
    bad = (F.col(label_col).isNull() if unparseable_value is None else (F.col(label_col) == unparseable_value))
    out = labelled.agg(F.count(F.lit(1)).alias("written"), F.count_if(bad).alias("unparseable"))
    out = out.unpivot([], ["written", "unparseable"], "status", "n")
    return skips.unionByName(out)
