"""Parse and flatten landed API JSON (S6 comment-thread pages, S7 video items).

Landed text is parsed by ``from_json``; nothing that cannot be read is lost silently.  Every
line gets a ``status``:

* ``ok``: one JSON object, every field of the expected type;
* ``partial``: one JSON object, but a field has another type, a required field is missing,
  or an item cannot be read as a whole; what can be read is there, the rest is null;
* ``corrupt``: anything else (cut off, several values in a line, a list, a bare value);
* ``empty``: null or white space only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

COMMENT_SNIPPET = StructType([
    StructField("authorDisplayName", StringType()), StructField("publishedAt", StringType()),
    StructField("updatedAt", StringType()), StructField("likeCount", LongType()),
    StructField("textOriginal", StringType())])
COMMENT = StructType([StructField("id", StringType()), StructField("snippet", COMMENT_SNIPPET)])
THREAD_ITEM = StructType([
    StructField("snippet", StructType([StructField("topLevelComment", COMMENT)])),
    StructField("replies", StructType([StructField("comments", ArrayType(COMMENT))]))])
THREAD_PAGE = StructType([
    StructField("video_id", StringType()), StructField("page", LongType()),
    StructField("items", ArrayType(THREAD_ITEM)), StructField("nextPageToken", StringType())])
VIDEO_ITEM = StructType([
    StructField("id", StringType()),
    StructField("snippet", StructType([
        StructField("title", StringType()), StructField("channelTitle", StringType()),
        StructField("publishedAt", StringType()), StructField("description", StringType()),
        StructField("tags", ArrayType(StringType()))])),
    StructField("statistics", StructType([
        StructField("viewCount", StringType()), StructField("likeCount", StringType()),
        StructField("commentCount", StringType())]))])

COMMENT_COLUMNS = ["comment_id", "parent_comment_id", "video_id", "is_reply", "author", "published_at",
                   "updated_at", "like_count", "text", "page"]


_BROKEN = "_broken"  # where from_json puts a record that it cannot read as a whole

_END = "end of the landed line"


def _object(text: Column) -> Column:
    """The one JSON object that ``text`` holds, else null; anything after or beside it makes the text unreadable."""
    # the parser stops where the first value ends: the mark shows that nothing else came before the end of the line
    values = F.from_json(F.concat(F.lit("["), text, F.lit(f', "{_END}"]')), "array<string>")
    one = (F.size(values) == 2) & (values[1] == _END) & text.rlike(r"^\s*\{")
    return F.when(one, values[0])


def _read(text: Column, schema: StructType) -> Column:
    return F.from_json(text, StructType([*schema.fields, StructField(_BROKEN, StringType())]),
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})


def _parsed(lines: DataFrame, text: str, schema: StructType, required: list[str], whole: Column) -> DataFrame:
    """``lines`` without ``text``, with ``_r`` (the record, null if unreadable) and ``status``."""
    held = [F.col(f"`{c}`") for c in lines.columns if c != text]
    rows = lines.select(*held, F.col(f"`{text}`").alias("_text"), _object(F.col(f"`{text}`")).alias("_object"))
    rows = rows.withColumn("_r", _read(F.col("_object"), schema))
    missing = [F.col(f"_r.{c}").isNull() for c in required]
    partial = F.col(f"_r.{_BROKEN}").isNotNull() | ~F.coalesce(whole, F.lit(True))
    for m in missing:
        partial = partial | m
    status = F.when(F.coalesce(F.trim(F.translate("_text", "\t\r\n", "   ")), F.lit("")) == "", "empty") \
              .when(F.col("_object").isNull(), "corrupt").when(partial, "partial").otherwise("ok")
    return rows.withColumn("status", status).drop("_text", "_object")


def parse_thread_pages(lines: DataFrame, text: str = "json") -> DataFrame:
    """S6 input: lines of text, one page each -> the other columns, the page's fields, ``n_broken_items`` and ``status``.

    Items are read one by one, so that an item that is no object at all costs only itself
    (it is null), and one with a field of another type only that field.
    """
    page = StructType([StructField(f.name, ArrayType(StringType()) if f.name == "items" else f.dataType) for f in THREAD_PAGE.fields])
    items = F.transform("_r.items", lambda x: F.when(x.startswith("{"), _read(x, THREAD_ITEM)))
    broken = F.size(F.filter(items, lambda i: i.isNull() | i[_BROKEN].isNotNull()))
    rows = _parsed(lines, text, page, ["video_id"], F.coalesce(broken, F.lit(0)) <= 0)
    plain = F.transform(items, lambda i: F.when(i.isNotNull(), F.struct(*[i[f.name].alias(f.name) for f in THREAD_ITEM.fields])))
    held = [F.col(f"`{c}`") for c in lines.columns if c != text]
    return rows.select(*held, F.col("_r.video_id"), F.col("_r.page"), plain.alias("items"), F.col("_r.nextPageToken"),
                       F.greatest(F.coalesce(broken, F.lit(0)), F.lit(0)).alias("n_broken_items"), "status")


def parse_video_items(lines: DataFrame, text: str = "json") -> DataFrame:
    """S7 input: lines of text, one video item each -> the other columns, the item's fields and ``status``."""
    rows = _parsed(lines, text, VIDEO_ITEM, ["id"], F.lit(True))
    held = [F.col(f"`{c}`") for c in lines.columns if c != text]
    return rows.select(*held, *[F.col(f"_r.{f.name}") for f in VIDEO_ITEM.fields], "status")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of landed text under ``path`` as ``(file, json)``; a line is a record."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))


def readable(parsed: DataFrame) -> DataFrame:
    """The records that hold something: status ``ok`` or ``partial``."""
    return parsed.filter(F.col("status").isin("ok", "partial"))


def _comment_cols(c, parent, is_reply: bool):
    s = c["snippet"]
    return [c["id"].alias("comment_id"), parent.alias("parent_comment_id"), F.col("video_id"),
            F.lit(is_reply).alias("is_reply"), s["authorDisplayName"].alias("author"),
            s["publishedAt"].alias("published_at"), s["updatedAt"].alias("updated_at"),
            s["likeCount"].alias("like_count"), s["textOriginal"].alias("text"), F.col("page")]


def flatten_thread_pages(pages: DataFrame) -> DataFrame:
    """One row per top-level comment and one per bundled reply (parent = top-level id)."""
    items = pages.select("video_id", "page", F.explode("items").alias("it")).filter(F.col("it").isNotNull())
    top = F.col("it.snippet.topLevelComment")
    tops = items.select(*_comment_cols(top, F.lit(None).cast("string"), False))
    reps = items.select("video_id", "page", top["id"].alias("_tid"),
                        F.explode_outer("it.replies.comments").alias("r")).filter(F.col("r").isNotNull())
    replies = reps.select(*_comment_cols(F.col("r"), F.col("_tid"), True))
    return tops.unionByName(replies)


def _count(c):
    return F.coalesce(c.try_cast("bigint"), F.lit(0)).cast("bigint")


def flatten_video_items(items: DataFrame, newspaper: str = "newspaper") -> DataFrame:
    """Video metadata row; missing description -> '', tags joined with ', ', counts default 0."""
    sn, st = F.col("snippet"), F.col("statistics")
    return items.select(
        F.col("id").alias("video_id"), F.col(newspaper).alias("newspaper"), sn["title"].alias("title"),
        sn["channelTitle"].alias("channel"), sn["publishedAt"].alias("published_at"),
        F.coalesce(sn["description"], F.lit("")).alias("description"),
        F.coalesce(F.array_join(sn["tags"], ", "), F.lit("")).alias("tags"),
        _count(st["viewCount"]).alias("view_count"), _count(st["likeCount"]).alias("like_count"),
        _count(st["commentCount"]).alias("comment_count"))
