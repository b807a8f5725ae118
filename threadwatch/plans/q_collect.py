"""Queries I1-I7, S6 and S7 on events, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwatch.functions.fixed import MAX_VIDEOS_PER_CHANNEL
from threadwatch.operators import collection
from threadwatch.plans import adapters as ad
from threadwatch.plans.registry import query
from threadwatch.sources import landed

AS_OF = "2024-01-30 00:00:00"
WANTED = "lastampa,repubblica"
CAP = 25


def event_videos(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return e.select(F.col("event_type").alias("newspaper"),
                    F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("video_id"),
                    F.col("ts").alias("published_at"))


@query("eligible_videos", f"""
SELECT * FROM (
  SELECT event_type AS newspaper, 'e' || event_id AS video_id, ts AS published_at,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, 'e' || event_id) AS INTEGER) AS position
  FROM events WHERE ts <= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) WHERE position <= 100""")
def eligible_videos(spark, sf_dir):
    return collection.eligible_videos(event_videos(spark, sf_dir), AS_OF,
                                      max_per_channel=MAX_VIDEOS_PER_CHANNEL).withColumn(
        "position", F.col("position").cast("int"))


@query("newspaper_filter", "WITH " + ad.SQL_VIDEO_FILES.strip() + f"""
SELECT newspaper, file_id, kind FROM video_files
WHERE newspaper IN ({", ".join("'" + n + "'" for n in WANTED.split(","))})""")
def newspaper_filter(spark, sf_dir):
    return collection.newspaper_filter(ad.video_files(spark, sf_dir), WANTED).select("newspaper", "file_id", "kind")


def api_and_scrape(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    vid = F.concat(F.lit("v"), F.floor(F.col("event_id") / 200).cast("string"))
    cid = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    rem20 = F.pmod(F.col("event_id"), F.lit(20))
    rem10 = F.pmod(F.col("event_id"), F.lit(10))
    api = e.filter(F.col("event_type") != "signup").select(
        vid.alias("video_id"), cid.alias("comment_id"),
        F.when(rem20 != 0, F.concat(F.lit("c"), (F.col("event_id") - rem20).cast("string"))).alias("parent_comment_id"),
        (rem20 != 0).alias("is_reply"), F.concat(F.lit("@U"), F.col("user_id").cast("string")).alias("author"),
        F.col("ts").alias("published_at"), F.col("ts").alias("updated_at"),
        F.floor("value").cast("bigint").alias("like_count"), F.col("props").alias("text"))
    us = F.timestamp_diff("MICROSECOND", F.lit(collection.EPOCH_NTZ).cast("timestamp_ntz"), F.col("ts"))
    epoch_text = F.concat(F.floor(us / 1_000_000).cast("bigint").cast("string"), F.lit("."),
                          F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))
    scraped = e.filter(F.col("event_type").isin("signup", "error")).select(
        vid.alias("video_id"), cid.alias("id"),
        F.when(rem10 == 0, F.lit("root")).otherwise(F.concat(F.lit("c"), (F.col("event_id") - rem10).cast("string")))
         .alias("parent"),
        F.when(F.pmod("user_id", F.lit(17)) == 0, F.lit("n/a")).otherwise(epoch_text).alias("timestamp"),
        F.concat(F.lit("@U"), F.col("user_id").cast("string")).alias("author"),
        F.when(F.pmod("user_id", F.lit(5)) != 0, F.floor("value").cast("bigint")).alias("like_count"),
        F.when(F.pmod("user_id", F.lit(7)) != 0, F.col("props")).alias("text"), F.lit(1).alias("arrival"))
    return api, scraped


SQL_SOURCES = """
WITH api AS (
  SELECT 'v' || CAST(floor(event_id / 200) AS BIGINT) AS video_id, 'c' || event_id AS comment_id,
         CASE WHEN event_id % 20 <> 0 THEN 'c' || (event_id - event_id % 20) END AS parent_comment_id,
         event_id % 20 <> 0 AS is_reply, '@U' || user_id AS author, ts AS published_at, ts AS updated_at,
         CAST(floor(value) AS BIGINT) AS like_count, props AS text
  FROM events WHERE event_type <> 'signup'),
scraped AS (
  SELECT 'v' || CAST(floor(event_id / 200) AS BIGINT) AS video_id, 'c' || event_id AS id,
         CASE WHEN event_id % 10 = 0 THEN 'root' ELSE 'c' || (event_id - event_id % 10) END AS parent,
         CASE WHEN user_id % 17 = 0 THEN 'n/a'
              ELSE CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0')
         END AS timestamp,
         '@U' || user_id AS author, CASE WHEN user_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS like_count,
         CASE WHEN user_id % 7 <> 0 THEN props END AS text
  FROM events WHERE event_type IN ('signup', 'error'))"""

SQL_TS = "make_timestamp(CAST(round(TRY_CAST(timestamp AS DOUBLE) * 1000000) AS BIGINT))"


@query("merge_sources", SQL_SOURCES + f"""
SELECT a.video_id, a.comment_id,
       coalesce(CASE WHEN s.parent <> 'root' THEN s.parent END, a.parent_comment_id) AS parent_comment_id,
       (s.parent IS NOT NULL AND s.parent <> 'root') OR a.is_reply AS is_reply,
       a.author, a.published_at, a.updated_at, a.like_count, a.text
FROM api a LEFT JOIN scraped s ON s.video_id = a.video_id AND s.id = a.comment_id
UNION ALL
SELECT s.video_id, s.id, CASE WHEN s.parent <> 'root' THEN s.parent END, coalesce(s.parent <> 'root', false),
       coalesce(s.author, ''), {SQL_TS}, CAST(NULL AS TIMESTAMP), coalesce(s.like_count, 0), coalesce(s.text, '')
FROM scraped s WHERE NOT EXISTS (SELECT 1 FROM api a WHERE a.video_id = s.video_id AND a.comment_id = s.id)""")
def merge_sources(spark, sf_dir):
    api, scraped = api_and_scrape(spark, sf_dir)
    # every third comment was scraped once before, as a reply to something greater; the later row counts
    stale = scraped.filter(F.pmod(F.substring("id", 2, 20).cast("bigint"), F.lit(3)) == 0) \
        .withColumn("parent", F.lit("zz")).withColumn("text", F.lit("stale")).withColumn("arrival", F.lit(0))
    blank = scraped.withColumn("id", F.lit(" \n"))
    return collection.merge_sources(api, stale.unionByName(scraped).unionByName(blank))


@query("epoch_to_ts", SQL_SOURCES + f"\nSELECT id, {SQL_TS} AS published_at FROM scraped")
def epoch_to_ts(spark, sf_dir):
    _, scraped = api_and_scrape(spark, sf_dir)
    return scraped.select("id", collection.epoch_to_ntz(F.col("timestamp")).alias("published_at"))


@query("comment_cap", "WITH " + ad.SQL_EVENT_COMMENTS.strip() + f""",
pg AS (SELECT *, CAST(floor(CAST(substr(comment_id, 2) AS BIGINT) / 10) AS BIGINT) AS page FROM event_comments),
pc AS (SELECT video_id, page, count(*) AS n FROM pg GROUP BY ALL),
keep AS (SELECT video_id, page FROM (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY video_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS before FROM pc) WHERE before < {CAP})
SELECT pg.video_id, pg.comment_id, pg.page FROM pg JOIN keep USING (video_id, page)""")
def comment_cap(spark, sf_dir):
    c = ad.event_comments(spark, sf_dir).withColumn(
        "page", F.floor(F.substring("comment_id", 2, 20).cast("bigint") / 10).cast("bigint"))
    return collection.comment_cap(c, "page", CAP).select("video_id", "comment_id", "page")


@query("empty_videos", "WITH " + ad.SQL_VIDEO_FILES.strip() + ",\n" + ad.SQL_COMMENT_ROWS.strip() + """
SELECT DISTINCT newspaper, file_id FROM video_files v
WHERE NOT EXISTS (SELECT 1 FROM comment_rows c WHERE c.newspaper = v.newspaper AND c.file_id = v.file_id)""")
def empty_videos(spark, sf_dir):
    v = ad.video_files(spark, sf_dir).select("newspaper", "file_id").distinct()
    return collection.empty_videos(v, ad.comment_rows(spark, sf_dir), ["newspaper", "file_id"])


# ---------------------------------------------------------------- landed JSON

def conversation_pages(spark, sf_dir):
    """Conversations as landed API thread pages (JSON text): turn 0 is the thread, later turns its bundled replies."""
    c = ad.table(spark, sf_dir, "conversations")
    iso = F.concat(F.lit("2024-01-01T00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00Z"))
    com = F.struct(F.concat(F.lit("k"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
                   .alias("id"),
                   F.struct(F.col("role").alias("authorDisplayName"), iso.alias("publishedAt"),
                            iso.alias("updatedAt"), F.col("turn").alias("likeCount"),
                            F.col("text").alias("textOriginal")).alias("snippet"))
    per = c.groupBy("conv_id").agg(
        F.min_by(com, F.col("turn")).alias("top"),
        F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.struct(F.col("turn").alias("t"), com.alias("c")))))
        .alias("reps"))
    item = F.struct(F.struct(F.col("top").alias("topLevelComment")).alias("snippet"),
                    F.when(F.size("reps") > 0, F.struct(F.transform("reps", lambda x: x["c"]).alias("comments")))
                    .alias("replies"))
    pages = per.select(F.concat(F.lit("conv"), F.floor(F.col("conv_id") / 50).cast("string")).alias("video_id"),
                       F.floor(F.col("conv_id") / 5).cast("bigint").alias("page"), item.alias("it"))
    pages = pages.groupBy("video_id", "page").agg(F.collect_list("it").alias("items"))
    return pages.select(F.col("video_id").alias("source"), F.to_json(F.struct("video_id", "page", "items")).alias("json"))


@query("flatten_threads", """
SELECT 'k' || conv_id || ':' || turn AS comment_id,
       CASE WHEN turn > 0 THEN 'k' || conv_id || ':0' END AS parent_comment_id,
       'conv' || CAST(floor(conv_id / 50) AS BIGINT) AS video_id, turn > 0 AS is_reply, role AS author,
       '2024-01-01T00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':00Z' AS published_at,
       '2024-01-01T00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':00Z' AS updated_at,
       turn AS like_count, text, CAST(floor(conv_id / 5) AS BIGINT) AS page
FROM conversations""")
def flatten_threads(spark, sf_dir):
    pages = landed.parse_thread_pages(conversation_pages(spark, sf_dir))
    return landed.flatten_thread_pages(landed.readable(pages))


@query("landed_page_status", """
WITH pages AS (SELECT 'conv' || CAST(floor(conv_id / 50) AS BIGINT) AS source, CAST(floor(conv_id / 5) AS BIGINT) AS page,
                      count(DISTINCT conv_id) AS items, count(*) AS comments
               FROM conversations GROUP BY ALL),
per AS (SELECT source, count(*) AS n_lines, sum(items) AS items, sum(comments) AS comments FROM pages GROUP BY source)
SELECT source, status, n_lines, CAST(CASE WHEN read THEN items ELSE 0 END AS BIGINT) AS n_items,
       CAST(CASE WHEN status = 'partial' THEN items ELSE 0 END AS BIGINT) AS n_broken_items,
       CAST(CASE WHEN read THEN comments ELSE 0 END AS BIGINT) AS n_comments,
       CAST(CASE WHEN status = 'ok' THEN comments ELSE 0 END AS BIGINT) AS n_like_counts
FROM per, (VALUES ('ok', true), ('partial', true), ('corrupt', false), ('empty', false)) s(status, read)""")
def landed_page_status(spark, sf_dir):
    """How the lines of a landing folder read, where every page also landed cut off, with words for counts, and blank."""
    whole = conversation_pages(spark, sf_dir)
    half = F.col("json").substr(F.lit(1), (F.length("json") / 2).cast("int"))
    lines = whole.select("source", F.explode(F.array(
        "json", half, F.regexp_replace("json", r'"likeCount":\d+', '"likeCount":"many"'), F.lit(" \t"))).alias("json"))
    pages = landed.parse_thread_pages(lines)
    n_replies = F.transform("items", lambda i: F.coalesce(F.size(i["replies"]["comments"]), F.lit(0)))
    likes = F.transform("items", lambda i: (i["snippet"]["topLevelComment"]["snippet"]["likeCount"].isNotNull()).cast("int") + F.size(
        F.filter(F.coalesce(i["replies"]["comments"], F.array()), lambda c: c["snippet"]["likeCount"].isNotNull())))
    def total(a):
        return F.aggregate(a, F.lit(0), lambda x, y: x + F.greatest(y, F.lit(0)))
    n_items = F.greatest(F.size("items"), F.lit(0))
    return pages.groupBy("source", "status").agg(
        F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(n_items), F.lit(0)).alias("n_items"),
        F.sum("n_broken_items").cast("bigint").alias("n_broken_items"),
        F.sum(F.coalesce(n_items + total(n_replies), F.lit(0))).cast("bigint").alias("n_comments"),
        F.sum(F.coalesce(total(likes), F.lit(0))).cast("bigint").alias("n_like_counts"))


def order_items(spark, sf_dir):
    """Orders as landed video items (JSON text)."""
    o = ad.table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    item = F.struct(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        F.struct(F.col("o_orderpriority").alias("title"), ad.newspaper_of(F.col("o_orderkey")).alias("channelTitle"),
                 F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
                 F.when(st != "P", F.concat(F.lit("order in status "), st)).alias("description"),
                 F.when(st != "O", F.array(st, F.col("o_orderpriority"))).alias("tags")).alias("snippet"),
        F.struct(F.floor("o_totalprice").cast("bigint").cast("string").alias("viewCount"),
                 F.when(F.pmod("o_custkey", F.lit(3)) != 0, F.col("o_custkey").cast("string")).alias("likeCount"),
                 F.when(st == "P", F.lit("n/a")).alias("commentCount")).alias("statistics"))
    return o.select(F.to_json(item).alias("json"), ad.newspaper_of(F.col("o_orderkey")).alias("newspaper"))


@query("flatten_videos", f"""
SELECT 'o' || o_orderkey AS video_id, {ad.sql_pick(ad.NEWSPAPERS, 'o_orderkey')} AS newspaper,
       o_orderpriority AS title, {ad.sql_pick(ad.NEWSPAPERS, 'o_orderkey')} AS channel,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_at,
       CASE WHEN o_orderstatus <> 'P' THEN 'order in status ' || o_orderstatus ELSE '' END AS description,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus || ', ' || o_orderpriority ELSE '' END AS tags,
       CAST(floor(o_totalprice) AS BIGINT) AS view_count,
       CAST(CASE WHEN o_custkey % 3 <> 0 THEN o_custkey ELSE 0 END AS BIGINT) AS like_count,
       CAST(0 AS BIGINT) AS comment_count
FROM orders""")
def flatten_videos(spark, sf_dir):
    return landed.flatten_video_items(landed.readable(landed.parse_video_items(order_items(spark, sf_dir))))
