"""V11 surface, S5 loader checks, S8 author map, I-family on small tables."""

import datetime as dt
import math
import tempfile

import pytest
from pyspark.sql import functions as F

from threadwatch.operators import collection, figures
from threadwatch.sources import corpus
from threadwatch.sources.dataset import dropped_label_count, load_dataset


def test_score_surface_region(spark):
    s = figures.score_surface(spark, max_offensive=10, grid=50)
    assert s.count() == 2500
    r = s.filter("i = 49 AND j = 49").first()
    assert r["n_offensive"] == pytest.approx(15.0)
    assert r["score"] == pytest.approx(math.atan(1 + math.log(15)) / (math.pi / 2))
    assert s.filter("i = 0 AND j = 0").first()["in_region"] is False


def test_load_dataset_checks_and_drops(spark):
    df = spark.createDataFrame([("a", "np", "1", "t"), ("b", "np", "x", "t"), ("c", "np", None, None)],
                               "video_id string, newspaper string, offensive_trigger string, video_topic string")
    out = load_dataset(df)
    assert sorted(r["video_id"] for r in out.collect()) == ["a"]
    assert dropped_label_count(df).first()[0] == 2
    with pytest.raises(KeyError):
        load_dataset(df.drop("video_topic"), need_topic=True)


def test_author_map_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="tw-map-")
    assert corpus.load_author_map(spark, f"{base}/missing").count() == 0
    m = spark.createDataFrame([("@a", "author_0")], "author string, author_anon string")
    corpus.save_author_map(m, f"{base}/v1")
    assert corpus.load_author_map(spark, f"{base}/v1").first()["author_anon"] == "author_0"
    with pytest.raises(Exception):
        corpus.save_author_map(m, f"{base}/v1")   # never overwrite in place


def test_eligible_and_cap(spark):
    t0 = dt.datetime(2024, 1, 10)
    vids = spark.createDataFrame([("a", f"v{i}", t0 - dt.timedelta(hours=i)) for i in range(30)],
                                 "newspaper string, video_id string, published_at timestamp_ntz")
    e = collection.eligible_videos(vids, "2024-01-10 12:00:00", max_per_channel=5)
    assert [r["video_id"] for r in e.orderBy("position").collect()] == ["v12", "v13", "v14", "v15", "v16"]
    com = spark.createDataFrame([("v", i, i // 3) for i in range(10)], "video_id string, cid int, page int")
    kept = collection.comment_cap(com, "page", cap=5)
    assert kept.count() == 6   # pages of 3: 0 before, 3 before -> kept; 6 before -> dropped


def test_epoch_parse(spark):
    df = spark.createDataFrame([("1704067207.179575",), ("n/a",), (None,)], "t string")
    got = [r[0] for r in df.select(collection.epoch_to_ntz(F.col("t"))).collect()]
    assert got == [dt.datetime(2024, 1, 1, 0, 0, 7, 179575), None, None]


def test_figures_row_and_file_aggregate_paths_agree(spark):
    rows = [("gold", "np1", "f1", 1), ("gold", "np1", "f1", 0), ("gold", "np1", "f1", None),
            ("silver", "np2", "f2", 1), ("silver", "np2", "f3", None), ("silver", "np1", "f4", 0)]
    c = spark.createDataFrame(rows, "kind string, newspaper string, file_id string, label int")
    m = spark.createDataFrame([("gold", "np1", "f1", "sport"), ("silver", "np2", "f2", "sport"),
                               ("silver", "np2", "f3", None), ("silver", "np1", "f4", "health")],
                              "kind string, newspaper string, file_id string, topic string")
    by_rows = figures.join_topics(c, m)
    by_files = figures.join_topics_agg(c, m)
    for fn in (figures.topic_stats, figures.newspaper_rates, figures.topic_stats_by_kind, figures.axis_labels):
        a = sorted(map(tuple, fn(by_rows).collect()), key=str)
        b = sorted(map(tuple, fn(by_files).collect()), key=str)
        assert a == b, fn.__name__


def test_annotator_tree_listing(spark):
    import os
    base = tempfile.mkdtemp(prefix="tw-ann-")
    for ann, np_, fid in [("A1", "lastampa", "_x1"), ("A2", "lastampa", "_x1"), ("A1", "repubblica", "y2")]:
        d = os.path.join(base, ann, "VideosComments/youtube/annotated_comments", np_)
        os.makedirs(d, exist_ok=True)
        open(os.path.join(d, f"{fid}.csv"), "w").write("comment_id,label\nc1,1\n")
    got = sorted((r["annotator"], r["newspaper"], r["file_id"])
                 for r in corpus.annotator_files(spark, base, ".csv").collect())
    assert got == [("A1", "lastampa", "_x1"), ("A1", "repubblica", "y2"), ("A2", "lastampa", "_x1")]


def test_sinks_roundtrip(spark):
    from threadwatch.sources import sinks
    base = tempfile.mkdtemp(prefix="tw-sink-")
    df = spark.createDataFrame([("np1", "gold", "c1", 'line one\nline "two"'), ("np2", "silver", "c2", "plain")],
                               "newspaper string, kind string, comment_id string, text string")
    sinks.write_table(df, f"{base}/parquet")
    back = spark.read.parquet(f"{base}/parquet")
    assert sorted(map(tuple, back.select("newspaper", "kind", "comment_id", "text").collect())) == \
        sorted(map(tuple, df.collect()))
    sinks.export_csv(df, f"{base}/csv")
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{base}/csv")
    assert sorted(r["text"] for r in csv.collect()) == sorted(r["text"] for r in df.collect())
    with pytest.raises(Exception):
        sinks.write_table(df, f"{base}/parquet")   # never overwrite silently


def test_channel_shortfall(spark):
    t0 = dt.datetime(2024, 1, 1)
    vids = spark.createDataFrame([("a", f"v{i}", t0) for i in range(3)] + [("b", f"w{i}", t0) for i in range(6)],
                                 "newspaper string, video_id string, published_at timestamp_ntz")
    e = collection.eligible_videos(vids, "2024-01-05 00:00:00", max_per_channel=5)
    short = {r[0]: r[1] for r in collection.channel_shortfall(e, max_per_channel=5).collect()}
    assert short == {"a": 3}


def test_scrape_rows_last_to_arrive_counts(spark):
    api = spark.createDataFrame([("v", "c1", None, False, "a", None, None, 0, "t")], "video_id string, comment_id string, "
                                "parent_comment_id string, is_reply boolean, author string, published_at timestamp_ntz, "
                                "updated_at timestamp_ntz, like_count long, text string")
    scraped = spark.createDataFrame([("v", "c1", "zz", "1", "a", 1, "t", 0), ("v", "c1", "aa", "1", "a", 1, "t", 1),
                                     ("v", " \n", "aa", "1", "a", 1, "t", 2)], "video_id string, id string, parent string, "
                                    "timestamp string, author string, like_count long, text string, arrival int")
    got = collection.merge_sources(api, scraped).collect()
    assert [(r.comment_id, r.parent_comment_id) for r in got] == [("c1", "aa")]


def test_unreadable_author_map_raises(spark, tmp_path):
    from threadwatch.sources import corpus
    assert corpus.load_author_map(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        corpus.load_author_map(spark, str(tmp_path / "bad")).count()


def test_gold_videos_need_a_topic(spark):
    from threadwatch.operators import annotate
    df = spark.createDataFrame([("a", "Sport"), ("b", " \n\u00a0"), ("c", None)], "file_id string, topic string")
    assert [r.topic for r in annotate.gold_videos(df).collect()] == ["sport"]
    assert tuple(annotate.dropped_topics(df).first()) == (1, 2)
    with pytest.raises(ValueError):
        annotate.gold_videos(df.filter("file_id <> 'a'"))


def fitted(spark):
    """Models fitted on texts in which one word tells the classes apart."""
    from threadwatch.operators import textmodel
    rows = [(i, f"the {w} of day number{i % 9}" + (" you IDIOT" if i % 4 == 0 else ""), int(i % 4 == 0))
            for i, w in enumerate(["weather", "bridge", "council", "river"] * 30)]
    rows += [(900, None, 0), (901, "idiot without a label", None)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    hashed = df.select("id", "text", "label", textmodel.fold_of(F.col("id")).alias("fold"),
                       textmodel.word_buckets(F.col("text")).alias("buckets"))
    return textmodel, hashed, textmodel.fit(hashed, "label")


def test_fitted_models_follow_the_text(spark):
    textmodel, hashed, models = fitted(spark)
    assert len(models) == 6 and all(0 < len(m.weights) <= textmodel.KEPT for m in models)
    for key in textmodel.SIZES:
        scored = hashed.withColumn("s", textmodel.score(models, key, F.col("fold"), F.col("buckets"))).collect()
        by_fold = {m.fold: m for m in models if m.model_key == key}
        for r in scored:  # the same weights score the text itself
            assert r.s == (by_fold[r.fold].score_text(r.text) if r.text else by_fold[r.fold].bias)
        assert all((r.s >= 0) == (r.label == 1) for r in scored if r.label is not None and r.text)
    assert models[0].score_text("12 !?") is None


def test_fit_equals_brute_force(spark):
    import math
    textmodel, hashed, models = fitted(spark)
    rows = [r for r in hashed.collect() if r.label is not None]
    for m in models:
        own = [r for r in rows if r.fold != m.fold]
        n = [{}, {}]
        for r in own:
            for b in r.buckets:
                n[r.label][b % m.size] = n[r.label].get(b % m.size, 0) + 1
        t = [sum(x.values()) for x in n]
        lean = {b: n[1].get(b, 0) * t[0] - n[0].get(b, 0) * t[1] for b in n[0].keys() | n[1].keys()}
        kept = sorted(lean, key=lambda b: (-lean[b], b))[:textmodel.KEPT]
        want = {b: round(textmodel.UNIT * math.log((2 * n[1].get(b, 0) + 1) * (2 * t[0] + m.size)
                                                   / ((2 * n[0].get(b, 0) + 1) * (2 * t[1] + m.size)))) for b in kept}
        assert m.weights == want
        d1 = sum(r.label for r in own)
        assert m.bias == round(textmodel.UNIT * math.log((2 * d1 + 1) / (2 * (len(own) - d1) + 1)))


def test_no_labels_no_weights(spark):
    textmodel, hashed, _ = fitted(spark)
    models = textmodel.fit(hashed.filter("label is null"), "label")
    assert {(m.bias, len(m.weights)) for m in models} == {(0, 0)}
    assert {r[0] for r in hashed.select(textmodel.score(models, "gemma2", F.col("fold"), F.col("buckets"))).collect()} == {0}


def test_comment_rule_reads_the_target_only(spark):
    from threadwatch.functions.prompt_text import COMMENT_PROMPT
    from threadwatch.operators import lexicon, prompts
    _, _, models = fitted(spark)
    fields = dict(video_title="idiot", video_description="idiot", head_comment="idiot", previous_comment="idiot")
    rule = lexicon.FittedRule(models[-1], *prompts.around(COMMENT_PROMPT, "target_comment"))
    said = rule([COMMENT_PROMPT.format(**fields, target_comment=t) for t in ("the river of day", "you idiot", "?!")])
    assert said[0] in ("Direi di no", "sì? no") and said[1] in ("Sì, è offensivo", "SÌ!") and said[2] == "non saprei"


def test_bare_answers(spark):
    from threadwatch.functions.taxonomy import with_parsed_topic
    from threadwatch.functions.text import parse_label
    from threadwatch.plans.q_annotate import ANSWER_LEADS
    df = spark.createDataFrame([(i, a) for i, a in enumerate([*ANSWER_LEADS, None])], "id int, answer string")
    got = [r[0] for r in df.orderBy("id").select(parse_label(F.col("answer"))).collect()]
    assert got == [1, 0, 0, 1, 1, None, None, None, None, None, None, None, None, None, None]
    topics = {r.id: r.topic for r in with_parsed_topic(df, "answer").collect()}
    assert topics[8] == "sport" and topics[10] == "sport" and topics[5] is None and topics[14] is None


def moody(bad):
    """A predictor that fails on some prompts, and answers wrongly many at once on others."""
    def predict(prompts):
        if any(w in p for p in prompts for w in bad):
            raise RuntimeError("out of memory")
        return ["s\u00ec" if "yes" in p else "no" for p in prompts if "short" not in p or len(prompts) == 1]

    return lambda: predict


def test_failing_predictor_and_resumed_run(spark, tmp_path):
    from threadwatch.operators import annotate
    rows = [(f"v{i}", i, f"prompt {i} {'yes' if i % 2 else 'no'}" + (" boom" if i in (3, 30) else "") + (" short" if i == 9 else ""))
            for i in range(50)] + [(None, 1, "a null key"), ("e", 2, "")]
    df = spark.createDataFrame(rows, "video string, n int, prompt string").repartition(4)
    path = str(tmp_path / "outcomes")
    answers, failures = annotate.score_and_keep(df, ["video", "n"], "prompt", moody(["boom"]), path, slices=3)
    assert {(r.video, r.n): r.error for r in failures.collect()} == {("v3", 3): "RuntimeError: out of memory",
                                                                    ("v30", 30): "RuntimeError: out of memory"}
    assert answers.count() == 50 and {r.raw_answer for r in answers.collect()} == {"s\u00ec", "no"}
    statuses = df.withColumn("status", F.lit("pending"))
    labelled = annotate.attach_silver_label(answers)
    counted = {r.status: r.n for r in annotate.annotation_counters(statuses, labelled, "label").collect()}
    assert counted["errors"] == 2 and counted["written"] == 50
    # a second run asks only what has no answer, new prompts included
    asked = spark.createDataFrame([*rows, ("new", 7, "yes")], "video string, n int, prompt string")
    before = spark.read.parquet(f"{path}/*").count()
    answers, failures = annotate.score_and_keep(asked, ["video", "n"], "prompt", moody([]), path)
    assert spark.read.parquet(f"{path}/*").count() - before == 3
    assert failures.count() == 0 and answers.count() == 53
    # a third one, with a predictor that always fails, asks nothing
    answers, failures = annotate.score_and_keep(asked, ["video", "n"], "prompt", moody([""]), path)
    assert failures.count() == 0 and answers.count() == 53
