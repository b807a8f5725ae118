"""Thread reconstruction.

* T3a (who is mentioned): a reply's leading ``@token`` resolves to the
  longest sibling handle that is a prefix of the token.  Instead of pairing
  each reply with every handle of its thread, the token is expanded into its
  prefixes (no longer than the longest handle) and equi-joined with the
  distinct handles of the thread, so work is linear in replies, not
  quadratic in thread size.
* T3b (which of their comments): an as-of pick (``operators.asof``): probes
  and candidates are scanned in one global order with a running last value
  and one row carried from partition to partition, so a hot author in a
  giant thread, or at one instant, is spread over tasks.
* T4 (depth): pointer jumping; each round joins the rows still on their way
  to the node their pointer names, doubling the hop length, so chains of
  length L finish in about log2(L) rounds; finished rows are not written
  again.  Rows that never finish lead into a cycle: doubling finds the
  cycles' nodes and names, and the others follow their pointers to those.
* T5 (context): two left joins on ``(video_id, comment_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwatch.functions.text import leading_mention, norm_handle
from threadwatch.operators.asof import asof_latest
from threadwatch.session import cut_lineage

ROOT_GROUP = "\u0000top"  # stands for a null parent in grouping keys


def _thread_key(parent: str = "parent_comment_id"):
    return F.coalesce(F.col(parent), F.lit(ROOT_GROUP))


def resolve_mentions(comments: DataFrame, max_handle_len: int | None = None) -> DataFrame:
    """T1 + T2 + T3a: ``(video_id, comment_id, target_handle)`` for replies whose mention resolves."""
    base = comments.select("video_id", "comment_id", "parent_comment_id", "is_reply", "text",
                           norm_handle(F.coalesce(F.col("author").cast("string"), F.lit("nan"))).alias("handle"))
    handles = base.select("video_id", _thread_key().alias("tk"), "handle").distinct()
    if max_handle_len is None:
        max_handle_len = handles.agg(F.max(F.length("handle"))).first()[0] or 0
    probes = base.filter(F.col("is_reply")).select(
        "video_id", "comment_id", _thread_key().alias("tk"), leading_mention(F.col("text")).alias("token"))
    probes = probes.filter(F.col("token").isNotNull())
    n = F.least(F.length("token"), F.lit(max_handle_len))
    expanded = probes.select("video_id", "comment_id", "tk", "token", F.explode(F.sequence(F.lit(0), n)).alias("k"))
    expanded = expanded.withColumn("handle", F.substring(F.col("token"), F.lit(1), F.col("k")))
    hits = expanded.join(handles, ["video_id", "tk", "handle"], "inner")
    return hits.groupBy("video_id", "comment_id").agg(
        F.max_by("handle", F.length("handle")).alias("target_handle"))


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since the epoch, independent of the session time zone for NTZ columns."""
    dtype = df.schema[col].dataType.typeName()
    if dtype == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))
    return F.unix_micros(F.col(col).cast("timestamp"))


def infer_parents(comments: DataFrame, max_handle_len: int | None = None,
                  n_parts: int | None = None) -> DataFrame:
    """Adds ``inferred_parent_id`` (the parent unless a mention resolves to an earlier sibling)."""
    targets = resolve_mentions(comments, max_handle_len)
    ts = epoch_micros(comments, "published_at")
    rows = comments.select(
        "video_id", "comment_id", _thread_key().alias("tk"), ts.alias("t"),
        norm_handle(F.coalesce(F.col("author").cast("string"), F.lit("nan"))).alias("handle"))
    rows = rows.filter(F.col("t").isNotNull())
    probes = rows.join(targets, ["video_id", "comment_id"]).select(
        "video_id", "tk", F.col("target_handle").alias("handle"), "t", "comment_id")
    cands = rows.select("video_id", "tk", "handle", "t", "comment_id")
    found = asof_latest(probes, cands, ["video_id", "tk", "handle"], n_parts=n_parts) \
        .select("video_id", "comment_id", F.col("found_id").alias("_found"))
    out = comments.join(found, ["video_id", "comment_id"], "left")
    return out.withColumn("inferred_parent_id", F.coalesce(F.col("_found"), F.col("parent_comment_id"))).drop("_found")


def _last_rows(comments: DataFrame, cols: list[str], arrival: str | None) -> DataFrame:
    """One row for each ``(video_id, comment_id)``: the last by ``arrival``, else the greatest."""
    keys = ["video_id", "comment_id"]
    row = F.struct(*cols)
    best = F.max(row) if arrival is None else F.max_by(row, F.struct(F.col(arrival), row))
    return comments.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def _follow(pending: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pointer jumping: ``pending(video_id, comment_id, p, ptr, dist)`` towards ``done(.., dist, root)``.

    Each round joins the rows still on their way with the node their pointer names and
    doubles the hops; rows that arrive are added to ``done`` and not written again.
    Returns (done, rows that never arrive), after at most log2 of a video's rows rounds.
    """
    keys = ["video_id", "comment_id"]
    pending = cut_lineage(pending)
    longest = pending.groupBy("video_id").count().agg(F.max("count")).first()[0] or 0
    hops, n = 1, longest
    while n:
        ends = done.select("video_id", F.col("comment_id").alias("ptr"), F.col("dist").alias("d_end"), "root")
        steps = pending.select("video_id", F.col("comment_id").alias("ptr"), F.col("ptr").alias("n_ptr"),
                               F.col("dist").alias("n_dist"))
        moved = cut_lineage(pending.join(ends, ["video_id", "ptr"], "left").join(steps, ["video_id", "ptr"], "left").select(
            *keys, "p", "n_ptr", F.coalesce("d_end", "n_dist").alias("add"), "dist", "root",
            F.col("d_end").isNotNull().alias("arrived")))
        total = (F.col("dist") + F.col("add")).alias("dist")
        done = done.unionByName(moved.filter("arrived").select(*keys, total, "root"))
        pending = moved.filter("not arrived").select(*keys, "p", F.col("n_ptr").alias("ptr"), total)
        n = pending.count()
        hops *= 2
        if hops > longest:  # no path among a video's rows is longer: what is left leads into a cycle
            break
    return done, pending if n else None


def _cycles(nodes: DataFrame) -> DataFrame:
    """``(video_id, comment_id, dist, root)`` of the nodes on cycles among ``nodes(.., p)``, all of which lead into one.

    After as many hops as there are nodes every walk is on its cycle, so the ends of the
    walks are the cycles' nodes; their smallest id along the way names the cycle.
    """
    walk = cut_lineage(nodes.select("video_id", "comment_id", F.col("p").alias("ptr"), F.least("comment_id", "p").alias("least")))
    longest = walk.groupBy("video_id").count().agg(F.max("count")).first()[0] or 0
    hops = 1
    while hops < longest:
        nxt = walk.select("video_id", F.col("comment_id").alias("ptr"), F.col("ptr").alias("n_ptr"), F.col("least").alias("n_least"))
        walk = cut_lineage(walk.join(nxt, ["video_id", "ptr"]).select(
            "video_id", "comment_id", F.col("n_ptr").alias("ptr"), F.least("least", "n_least").alias("least")))
        hops *= 2
    on = walk.select("video_id", F.col("ptr").alias("comment_id")).distinct()
    named = on.join(walk.select("video_id", "comment_id", "least"), ["video_id", "comment_id"])
    sizes = named.groupBy("video_id", "least").agg(F.count("*").cast("int").alias("dist"))
    return named.join(sizes, ["video_id", "least"]).select("video_id", "comment_id", "dist", F.col("comment_id").alias("root"))


def thread_depth(comments: DataFrame, parent_col: str = "inferred_parent_id", arrival: str | None = None) -> DataFrame:
    """T4: ``depth`` (hops to a top-level comment, an unknown id, or a repeat) and ``root_id``.

    ``root_id`` is where the walk along parents stops (used for the head text).  A walk
    into a cycle stops at the first repeated node: a node of a cycle of L nodes has depth L
    and itself as root; one that leads into it at h hops has depth h + L and the node where
    it enters as root.  Of rows with one id the last by ``arrival`` counts.
    """
    nodes = _last_rows(comments.select("video_id", "comment_id", F.col(parent_col).alias("p"), "is_reply",
                                       *([arrival] if arrival else [])), ["p", "is_reply"], arrival)
    known = nodes.select("video_id", F.col("comment_id").alias("p"), F.lit(True).alias("_known"))
    n = cut_lineage(nodes.join(known, ["video_id", "p"], "left"))
    top = ~F.coalesce(F.col("is_reply"), F.lit(False))
    ends = top | F.col("p").isNull() | F.col("_known").isNull()
    done = n.filter(ends).select(
        "video_id", "comment_id", F.when(top, 0).otherwise(1).cast("int").alias("dist"),
        F.when(top | F.col("p").isNull(), F.col("comment_id")).otherwise(F.col("p")).alias("root"))
    pending = n.filter(~ends).select("video_id", "comment_id", "p", F.col("p").alias("ptr"), F.lit(1).alias("dist"))
    done, circling = _follow(pending, done)
    if circling is not None:
        walkers = circling.select("video_id", "comment_id", "p")
        cycles = cut_lineage(_cycles(walkers))
        tails = walkers.join(cycles.select("video_id", "comment_id"), ["video_id", "comment_id"], "left_anti") \
            .select("video_id", "comment_id", "p", F.col("p").alias("ptr"), F.lit(1).alias("dist"))
        entered, _ = _follow(tails, cycles)
        done = done.unionByName(entered)
    return done.select("video_id", "comment_id", F.col("dist").cast("int").alias("depth"), F.col("root").alias("root_id"))


def context_columns(comments: DataFrame, depths: DataFrame, parent_col: str = "inferred_parent_id",
                    arrival: str | None = None) -> DataFrame:
    """T5: ``head_comment_text`` (root's text, depth >= 1) and ``previous_comment_text`` (parent's, depth >= 2).

    Of rows with one id the last by ``arrival`` lends its text (without it, the greatest text).
    """
    texts = _last_rows(comments, ["text"], arrival)
    c = comments.join(depths, ["video_id", "comment_id"], "left")
    root_t = texts.select("video_id", F.col("comment_id").alias("root_id"), F.col("text").alias("_head"))
    par_t = texts.select("video_id", F.col("comment_id").alias(parent_col), F.col("text").alias("_prev"))
    c = c.join(root_t, ["video_id", "root_id"], "left").join(par_t, ["video_id", parent_col], "left")
    return c.withColumn("head_comment_text", F.when(F.col("depth") >= 1, F.col("_head"))) \
            .withColumn("previous_comment_text", F.when(F.col("depth") >= 2, F.col("_prev"))) \
            .drop("_head", "_prev")
