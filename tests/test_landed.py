"""Landed JSON text: whole, partly readable, unreadable and blank lines."""

import json

import pytest

from threadwatch.sources import landed


def comment(cid, likes=3, text="x"):
    return {"id": cid, "snippet": {"authorDisplayName": "@a", "publishedAt": "2024-01-01T00:00:00Z", "likeCount": likes, "textOriginal": text}}


def page(*items, **more):
    return {"video_id": "v", "page": 1, "items": list(items), **more}


def item(cid, *replies, **more):
    out = {"snippet": {"topLevelComment": comment(cid, **more)}}
    if replies:
        out["replies"] = {"comments": [comment(r) for r in replies]}
    return out


GOOD = json.dumps(page(item("a", "r1", "r2"), item("b")))
LINES = {
    "good": (GOOD, "ok", 2, 0), "unknown fields": (json.dumps(page(item("a"), etag="z", kind=[1])), "ok", 1, 0),
    "no items": (json.dumps({"video_id": "v"}), "ok", None, 0), "empty items": (json.dumps(page()), "ok", 0, 0),
    "cut": (GOOD[:70], "corrupt", None, 0), "two": (GOOD + GOOD, "corrupt", None, 0), "listed": (f"[{GOOD}]", "corrupt", None, 0),
    "comma": (f"{GOOD},{GOOD}", "corrupt", None, 0), "junk": (GOOD + " junk", "corrupt", None, 0), "number": ("12", "corrupt", None, 0),
    "null": ("null", "corrupt", None, 0), "text": ('"{}"', "corrupt", None, 0), "bracket": ("{}]", "corrupt", None, 0),
    "closed and opened": ("{}] [{}", "corrupt", None, 0),
    "likes": (json.dumps(page(item("a", likes="many"), item("b"))), "partial", 2, 1),
    "bare item": (json.dumps(page(5, item("b"))), "partial", 2, 1), "null item": (json.dumps(page(None, item("b"))), "partial", 2, 1),
    "page": (json.dumps({**page(item("a")), "page": "p"}), "partial", 1, 0), "no id": (json.dumps({"items": [item("a")]}), "partial", 1, 0),
    "nothing": ("{}", "partial", None, 0), "blank": (" \t\r", "empty", None, 0), "void": (None, "empty", None, 0), "none": ("", "empty", None, 0),
    "brackets in text": (json.dumps(page(item("a", text="}] {[ \" \\   é"))), "ok", 1, 0),
}


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame([(k, v[0], "keep") for k, v in LINES.items()], "name string, json string, status_of_file string")
    return landed.parse_thread_pages(df)


def test_page_statuses(pages):
    got = {r["name"]: (r["status"], None if r["items"] is None else len(r["items"]), r["n_broken_items"]) for r in pages.collect()}
    assert got == {k: v[1:] for k, v in LINES.items()}
    assert pages.columns == ["name", "status_of_file", "video_id", "page", "items", "nextPageToken", "n_broken_items", "status"]


def test_what_can_be_read_is_kept(pages):
    def flat(name):
        rows = landed.flatten_thread_pages(landed.readable(pages.filter(pages["name"] == name))).collect()
        return sorted((r["comment_id"], r["parent_comment_id"], r["like_count"]) for r in rows)
    assert flat("good") == [("a", None, 3), ("b", None, 3), ("r1", "a", 3), ("r2", "a", 3)]
    assert flat("likes") == [("a", None, None), ("b", None, 3)]
    assert flat("bare item") == flat("null item") == [("b", None, 3)]
    assert flat("page") == flat("no id") == [("a", None, 3)]
    assert flat("cut") == flat("void") == flat("no items") == []
    text = landed.flatten_thread_pages(pages.filter(pages["name"] == "brackets in text")).first()["text"]
    assert text == "}] {[ \" \\   é"


def test_video_items(spark):
    good = {"id": "v1", "snippet": {"title": "T", "tags": ["a", "b"]}, "statistics": {"viewCount": "7", "likeCount": "x"}}
    lines = [("good", json.dumps(good)), ("tags", json.dumps({**good, "snippet": {"title": "T", "tags": "a"}})),
             ("no id", json.dumps({"snippet": {}})), ("cut", json.dumps(good)[:30]), ("blank", " ")]
    parsed = landed.parse_video_items(spark.createDataFrame(lines, "newspaper string, json string"))
    assert {r["newspaper"]: r["status"] for r in parsed.collect()} == {
        "good": "ok", "tags": "partial", "no id": "partial", "cut": "corrupt", "blank": "empty"}
    rows = {r["newspaper"]: r for r in landed.flatten_video_items(landed.readable(parsed)).collect()}
    assert set(rows) == {"good", "tags", "no id"} and rows["good"]["view_count"] == 7 and rows["good"]["like_count"] == 0
    assert rows["good"]["tags"] == "a, b" and rows["tags"]["tags"] == "" and rows["tags"]["title"] == "T"


def test_landed_files(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text(GOOD + "\n" + GOOD[:50] + "\n\n", encoding="utf-8")
    parsed = landed.parse_thread_pages(landed.read_landed(spark, str(tmp_path)))
    assert sorted(r["status"] for r in parsed.collect()) == ["corrupt", "empty", "ok"]
    assert all(r["file"].endswith("one.jsonl") for r in parsed.collect())
