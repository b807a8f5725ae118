"""Versioned commits with interleaved runs, and per-video CSV files with their headers."""

import csv
import io
import os

import pytest

from threadwatch.operators import collection
from threadwatch.sources import corpus, sinks, versions

SEEN = "author string, first_key long"


def test_interleaved_runs_give_no_number_twice(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "map")
    first = spark.createDataFrame([("@a", 1), ("@b", 2)], SEEN)
    assert versions.current(spark, root) == (0, None)
    assert corpus.extend_author_map(spark, root, first) == 1 == corpus.extend_author_map(spark, root, first)
    plain, once = versions.publish_table, []

    def other_run_first(df, place, base, *more):
        if not once:
            once.append(base)
            assert corpus.extend_author_map(spark, root, spark.createDataFrame([("@c", 3), ("@a", 0)], SEEN)) == 2
        return plain(df, place, base, *more)

    monkeypatch.setattr(versions, "publish_table", other_run_first)
    assert corpus.extend_author_map(spark, root, spark.createDataFrame([("@d", 4), ("@c", 5)], SEEN)) == 3
    version, amap = versions.read_table(spark, root, "author string, author_anon string")
    got = {r["author"]: r["author_anon"] for r in amap.collect()}
    assert version == 3 and set(got) == {"@a", "@b", "@c", "@d"} and len(set(got.values())) == 4
    old = {r["author"]: r["author_anon"] for r in spark.read.parquet(versions.folder_of(spark, root, 1)).collect()}
    assert old.items() <= got.items() and versions.versions(spark, root) == [1, 2, 3]
    assert len([f for f in os.listdir(root) if f.startswith("data-")]) == 3  # what the loser wrote is gone


def test_stale_base_and_failed_write_leave_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(3)
    assert versions.publish_table(df, root, 0) == 1
    for base in (0, 2):
        with pytest.raises(versions.Conflict):
            versions.publish_table(df, root, base)
    with pytest.raises(ZeroDivisionError):
        versions.publish(spark, root, 1, lambda folder: (df.write.parquet(folder), 1 / 0))
    assert versions.versions(spark, root) == [1] and len([f for f in os.listdir(root) if f.startswith("data-")]) == 1
    assert not versions._claim(spark, root, 1, "data-x") and versions.folder_of(spark, root, 1).startswith(f"{root}/data-")
    assert [f for f in os.listdir(f"{root}/_versions") if not f.endswith(".crc")] == ["000000000001"]


def whole(folder, newspaper, file_id):
    place = f"{folder}/newspaper={newspaper}/file_id={file_id}"
    return "".join(open(f"{place}/{p}", encoding="utf-8", newline="").read() for p in sorted(os.listdir(place)) if p.startswith("part-"))


def test_files_round_trip_with_headers(spark, tmp_path):
    schema = "newspaper string, file_id string, row_no long, comment_id string, text string, label string"
    rows = [("n", "_v1", 0, "c1", 'a, "b"\nnext', "1"), ("n", "_v1", 1, "c2", None, None), ("n", "_v1", 2, "c3", "", "0"),
            ("n", "other", 0, "c4", "t", "1"), ("n", "lost", 0, "c5", "t", "1")]
    rows += [("hot", "v9", i, f"d{i}", f"text {i}", str(i % 2)) for i in range(3000)]
    files = [("n", "_v1", ["label", "comment_id", "text"]), ("n", "bare", ["comment_id", "text"]), ("n", "empty", []),
             ("n", "other", None), ("hot", "v9", ["text", "comment_id", "label", "not there"])]
    lines = sinks.csv_lines(spark.createDataFrame(rows, schema),
                            spark.createDataFrame(files, "newspaper string, file_id string, header array<string>"), ["comment_id", "text"])
    root = str(tmp_path / "out")
    assert sinks.export_files(lines, root) == 1
    folder = versions.current(spark, root)[1]

    def read(*key):
        return list(csv.reader(io.StringIO(whole(folder, *key), newline="")))
    assert read("n", "_v1") == [["comment_id", "text", "label"], ["c1", 'a, "b"\nnext', "1"], ["c2", "", ""], ["c3", "", "0"]]
    assert whole(folder, "n", "bare") == "comment_id,text,label\n" and whole(folder, "n", "empty") == "label\n"
    assert read("n", "other") == [["comment_id", "text", "label"], ["c4", "t", "1"]] and not os.path.exists(f"{folder}/newspaper=n/file_id=lost")
    hot = read("hot", "v9")
    assert hot[0] == ["text", "comment_id", "not there", "label"] and hot[1:] == [[f"text {i}", f"d{i}", "", str(i % 2)] for i in range(3000)]
    assert len([p for p in os.listdir(f"{folder}/newspaper=hot/file_id=v9") if p.startswith("part-")]) > 1
    with pytest.raises(versions.Conflict):
        sinks.export_files(lines, root)
    assert sinks.export_files(lines.filter("file_id = 'bare'"), root, 1) == 2


def test_newspapers_are_pruned_partitions(spark, tmp_path):
    df = spark.createDataFrame([("lastampa", "c1"), ("repubblica", "c2"), ("corriere", "c3")], "newspaper string, comment_id string")
    versions.publish_table(df, str(tmp_path / "c"), 0, ("newspaper",))
    _, table = versions.read_table(spark, str(tmp_path / "c"), "newspaper string, comment_id string")
    wanted = collection.newspaper_filter(table, "lastampa,repubblica")
    assert sorted(r["comment_id"] for r in wanted.collect()) == ["c1", "c2"]
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [newspaper" in plan and "+- Filter" not in plan
