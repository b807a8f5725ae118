"""The corpus readers on a small tree with every kind of file."""

import json

import pytest
from pyspark.sql import functions as F

from threadwatch.operators import risk
from threadwatch.sources import corpus, files

HEADER = "comment_id,author,text,label,newspaper"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    comments = root / "comments"
    plain = {
        "corriere/v1_gold.csv": f"{HEADER}\nc1,anna,ciao,1,corriere\nc2,bea,\"a, b\nsecond \"\"line\"\"\",0,corriere\n",
        "corriere/_v2_silver.csv": f"{HEADER}\nc3,,,1.0,\n\nc4,dino,x,,corriere\n",
        "corriere/.v3_silver.csv": f"{HEADER}\n",
        "corriere/deep/er/v4_gold.csv": f"﻿{HEADER},more\nc5,e,t,1,n,extra col\n",
        "stampa/v5_gold.csv": "",
        "stampa/v6_gold.csv": f"{HEADER}\nc6,f\nc7,g,t,0,n,beyond,the header\n",
        "stampa/v7_gold.csv": f"{HEADER}\nc8,h,\"never closed,1,n\n",
        "stampa/v8_gold.csv": "text,comment_id\nonly two,c9\n",
        "stampa/v9_gold.csv": f"{HEADER}\n" + "".join(f"d{i},a,t{i},{i % 2},n\n" for i in range(9000)),
        "stampa/notes.txt": "not read",
        "v10_gold.csv": f"{HEADER}\nc10,top,level,0,n\n",
    }
    for name, text in plain.items():
        (comments / name).parent.mkdir(parents=True, exist_ok=True)
        (comments / name).write_text(text, encoding="utf-8")
    (comments / "stampa" / "v11_gold.csv").write_bytes(HEADER.encode() + b"\nc11,a,fine,1,n\n" * 1 + b"c12,\xff\xfe,bad,1,n\n")
    meta = root / "meta"
    for name, body in {"corriere/v1_gold.json": {"video_id": "v1", "title": "T", "topic": ["Politica", "Sport"]},
                       "corriere/_v2_silver.json": {"video_id": "v2", "topic": [], "view_count": 7},
                       "stampa/v5_gold.json": {"video_id": "v5", "topic": "Sport", "tags": ["a", "b"]}}.items():
        (meta / name).parent.mkdir(parents=True, exist_ok=True)
        (meta / name).write_text(json.dumps(body), encoding="utf-8")
    (meta / "stampa" / "v6_gold.json").write_text("{broken", encoding="utf-8")
    for annotator in ("A1", "A2"):
        for name in ("corriere/v1.csv", "stampa/_v5.csv"):
            (root / "work" / annotator / "done" / name).parent.mkdir(parents=True, exist_ok=True)
            (root / "work" / annotator / "done" / name).write_text("x\n", encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def read(spark, tree):
    return corpus.read_comment_files(spark, f"{tree}/comments")


def test_file_table(read):
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.n_rows, r.n_columns, r.n_ragged) for r in read[1].collect()}
    assert got == {"v1_gold.csv": ("ok", 2, 5, 0), "_v2_silver.csv": ("ok", 2, 5, 0), ".v3_silver.csv": ("ok", 0, 5, 0),
                   "v4_gold.csv": ("ok", 1, 6, 0), "v5_gold.csv": ("empty", 0, 0, 0), "v6_gold.csv": ("ok", 2, 5, 2),
                   "v7_gold.csv": ("error", 0, 0, 0), "v8_gold.csv": ("ok", 1, 2, 0), "v9_gold.csv": ("ok", 9000, 5, 0),
                   "v10_gold.csv": ("ok", 1, 5, 0), "v11_gold.csv": ("error", 0, 0, 0)}


def test_rows(read):
    rows = {r.comment_id: r for r in read[0].collect()}
    assert len(rows) == 9009 and {"c8", "c11", "c12"}.isdisjoint(rows)
    assert rows["c2"].text == 'a, b\nsecond "line"' and rows["c2"].row_no == 1 and rows["c2"].label == "0"
    assert (rows["c3"].author, rows["c3"].text, rows["c3"].label) == (None, None, "1.0")
    assert rows["c4"].row_no == 1 and rows["c5"].extra is None and rows["c5"].newspaper_dir == "er"
    assert rows["c6"].text is None and rows["c7"].extra == ["beyond", "the header"]
    assert (rows["c9"].text, rows["c9"].author) == ("only two", None)
    assert [rows[f"d{i}"].row_no for i in (0, 4095, 4096, 8999)] == [0, 4095, 4096, 8999]


def test_names_and_kinds(read):
    got = {r.path.rsplit("/", 1)[1]: (r.newspaper_dir, r.file_id, r.kind) for r in read[1].collect()}
    assert got["v1_gold.csv"] == ("corriere", "v1", "gold") and got["_v2_silver.csv"] == ("corriere", "_v2", "silver")
    assert got[".v3_silver.csv"] == ("corriere", ".v3", "silver") and got["v10_gold.csv"][1:] == ("v10", "gold")


def test_typed_comments_and_the_file_statistics(read):
    typed = {r.comment_id: r for r in corpus.typed_comments(read[0]).collect()}
    assert typed["c3"].label == 1.0 and typed["c3"].newspaper == "corriere" and typed["c4"].label is None
    stats = {r.file_id: (r.num_comments, r.num_offensive_comments) for r in corpus.comment_file_table(*read).collect()}
    assert stats["v1"] == (2, 1) and stats["_v2"] == (2, 1) and stats[".v3"] == (0, 0) and stats["v5"] == (0, 0)
    assert stats["v9"] == (9000, 4500) and stats["v8"] == (1, 0)


def test_one_parse_and_one_pass_over_the_files(spark, tree, read):
    for df in read:  # both halves read the stored table; no Python is left in their plans
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and "MapInPandas" not in plan


def test_files_are_dealt_by_bytes(spark, tree):
    listed = files.list_files(spark, f"{tree}/comments", ".csv")
    assert listed.count() == 11 and files.list_files(spark, f"{tree}/nowhere", ".csv").count() == 0
    sizes = {r.path.rsplit("/", 1)[1]: r.size for r in listed.collect()}
    assert sizes["v5_gold.csv"] == 0 and sizes["v9_gold.csv"] > 100_000
    many = spark.range(500).select(F.concat(F.lit("p"), "id").alias("path"), (F.col("id") % 7 * 100_000).alias("size"))
    parts = files.dealt(many, 8 << 20).groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum(F.col("size") + files.OPEN_BYTES).alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in parts) == 500 and max(r.b for r in parts) < 4 * (8 << 20) and len(parts) > 10


def test_metadata(spark, tree):
    got = {r.file_id: r for r in corpus.read_metadata_files(spark, f"{tree}/meta").collect()}
    assert got["v1"].topic == "Politica" and got["_v2"].topic is None and got["_v2"].view_count == "7"
    assert got["v5"].topic == "Sport" and got["v6"].status == "error" and got["v6"].video_id is None
    assert {r.newspaper_dir for r in got.values()} == {"corriere", "stampa"}


def test_annotators(spark, tree):
    got = {tuple(r) for r in corpus.annotator_files(spark, f"{tree}/work", ".csv").select(
        "annotator", "newspaper", "file_id").collect()}
    assert got == {(a, n, f) for a in ("A1", "A2") for n, f in (("corriere", "v1"), ("stampa", "_v5"))}


def test_dataset_from_the_tree(spark, tree, read):
    meta = corpus.read_metadata_files(spark, f"{tree}/meta").filter("status = 'ok'").select(
        F.col("newspaper_dir").alias("newspaper"), "file_id", "kind", "title", "description", "topic")
    ds = risk.build_dataset_from_stats(meta, corpus.comment_file_table(*read), with_flags=True)
    got = {(r.newspaper, r.video_id): r for r in ds.collect()}
    assert sum(r.has_metadata for r in got.values()) == 3 and sum(r.has_comments for r in got.values()) == 11


def test_union_frames(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, a string"), spark.createDataFrame([("y", 2)], "b string, id long")
    got = corpus.union_frames([a, b])
    assert got.columns == ["id", "a", "b"] and sorted(map(tuple, got.collect()), key=str) == [(1, "x", None), (2, None, "y")]
