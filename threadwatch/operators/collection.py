"""Collection-side table operators (I1-I7) over landed API and scrape rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwatch.functions.fixed import MIN_VIDEO_AGE_DAYS
from threadwatch.functions.text import unicode_strip

EPOCH_NTZ = "1970-01-01 00:00:00"


def eligible_videos(videos: DataFrame, as_of: str, channel: str = "newspaper", position: Column | None = None,
                    max_per_channel: int | None = None, min_age_days: int = MIN_VIDEO_AGE_DAYS,
                    published: str = "published_at") -> DataFrame:
    """Videos at least ``min_age_days`` old at ``as_of``, the first ``max_per_channel`` per channel (all without it).

    ``row_number() <= N`` over a channel window is planned as a window group
    limit: each map task keeps only its local top N per channel before the
    shuffle, so a channel holding most of the rows costs N rows per task.
    """
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(min_age_days))
    pos = position if position is not None else F.col(published).desc()
    w = Window.partitionBy(channel).orderBy(pos, "video_id")
    old = videos.filter(F.col(published) <= cutoff).withColumn("position", F.row_number().over(w))
    return old if max_per_channel is None else old.filter(F.col("position") <= max_per_channel)


def channel_shortfall(eligible: DataFrame, channel: str = "newspaper", *,
                      max_per_channel: int) -> DataFrame:
    """Channels with fewer eligible videos than wanted."""
    return eligible.groupBy(channel).agg(F.count(F.lit(1)).alias("found")) \
                   .filter(F.col("found") < max_per_channel)


def newspaper_filter(df: DataFrame, arg: str, col: str = "newspaper") -> DataFrame:
    """A comma-separated list of newspapers, or ``all`` (partition pruning on a partitioned table)."""
    if arg == "all":
        return df
    return df.filter(F.col(col).isin([a for a in arg.split(",")]))


def epoch_to_ntz(epoch_text: Column) -> Column:
    """Epoch seconds (text or number) -> UTC wall-clock ``timestamp_ntz``; non-numeric -> null."""
    secs = epoch_text.cast("string").try_cast("double")
    micros = F.round(secs * 1_000_000).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def merge_sources(api: DataFrame, scraped: DataFrame, arrival: str = "arrival") -> DataFrame:
    """I3 + I4: repair API parents from the scrape, then add scrape-only comments.

    ``api``: ``(video_id, comment_id, parent_comment_id, is_reply, author,
    published_at, updated_at, like_count, text)``; ``scraped``: ``(video_id,
    id, parent, timestamp, author, like_count, text)`` and ``arrival``, the order
    in which they were scraped.  Of scrape rows with one id the last to arrive counts;
    rows without an id, or with a blank one, are dropped.
    """
    s = scraped.filter(F.col("id").isNotNull() & (unicode_strip(F.col("id").cast("string")) != "")) \
        .groupBy("video_id", "id").agg(F.max_by(F.struct("parent", "timestamp", "author", "like_count", "text"),
                                                F.struct(F.col(arrival), F.col("parent"), F.col("text"))).alias("_s")) \
        .select("video_id", "id", "_s.*")
    real_parent = F.when(~F.col("parent").isin("root") & F.col("parent").isNotNull(), F.col("parent"))
    rep = s.select("video_id", F.col("id").alias("comment_id"), real_parent.alias("_rp"))
    a = api.join(rep, ["video_id", "comment_id"], "left")
    a = a.withColumn("parent_comment_id", F.coalesce("_rp", "parent_comment_id")) \
         .withColumn("is_reply", F.col("_rp").isNotNull() | F.col("is_reply")).drop("_rp")
    only = s.join(api.select("video_id", F.col("comment_id").alias("id")), ["video_id", "id"], "left_anti")
    added = only.select(
        "video_id", F.col("id").alias("comment_id"), real_parent.alias("parent_comment_id"),
        real_parent.isNotNull().alias("is_reply"), F.coalesce("author", F.lit("")).alias("author"),
        epoch_to_ntz(F.col("timestamp")).alias("published_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.coalesce("like_count", F.lit(0)).cast("bigint").alias("like_count"),
        F.coalesce("text", F.lit("")).alias("text"))
    return a.select(*added.columns).unionByName(added)


def comment_cap(comments: DataFrame, page: str = "page", cap: int | None = None,
                video: str = "video_id") -> DataFrame:
    """Whole pages are kept while the rows of the earlier pages number fewer than ``cap`` (all without it).

    Every page has at least one row, so only a video's first ``cap`` pages can
    be kept: a window group limit (local top-``cap`` before the shuffle) bounds
    the running-sum window to ``cap`` page rows per video, however hot the video.
    """
    if cap is None:
        return comments
    pages = comments.groupBy(video, page).agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy(video).orderBy(page)
    pages = pages.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= cap).drop("_rn")
    w = Window.partitionBy(video).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    keep = pages.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))) \
                .filter(F.col("_before") < cap).select(video, page)
    return comments.join(keep, [video, page], "left_semi")


def empty_videos(videos: DataFrame, comments: DataFrame, keys: list[str]) -> DataFrame:
    """Videos without any comment (they get count 0 in the dataset)."""
    return videos.join(comments.select(*keys).distinct(), keys, "left_anti")
