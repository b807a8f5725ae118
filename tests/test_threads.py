"""Threading (T2-T5) against a direct transcription of the walk semantics on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadwatch.operators import threads

SCHEMA = ("video_id string, comment_id string, parent_comment_id string, is_reply boolean, "
          "author string, published_at timestamp_ntz, text string")
T0 = dt.datetime(2024, 1, 1)


def ts(m):
    return None if m is None else T0 + dt.timedelta(minutes=m)


def rows_df(spark, rows):
    return spark.createDataFrame([(v, c, p, r, a, ts(t), x) for v, c, p, r, a, t, x in rows], SCHEMA)


def infer(spark, rows):
    out = threads.infer_parents(rows_df(spark, rows)).select("comment_id", "inferred_parent_id").collect()
    return {r[0]: r[1] for r in out}


def test_mentions_resolve_to_longest_prefix_among_siblings(spark):
    rows = [
        ("v", "top", None, False, "@Head", 0, "first"),
        ("v", "r1", "top", True, "@ann", 1, "hi"),
        ("v", "r2", "top", True, "@Anna", 2, "hello"),
        ("v", "r3", "top", True, "@zed", 3, "@annabel, sure"),      # ann and anna are prefixes -> anna
        ("v", "r4", "top", True, "@zed", 4, "@Head thanks"),        # top-level author is not a sibling
        ("v", "r5", "top", True, "@zed", 5, "@later hi"),           # only posts later -> unchanged
        ("v", "r6", "top", True, "@later", 6, "me"),
        ("v", "r7", "top", True, "@zed", 7, " ​@Ann! ok"),  # NBSP and ZWSP before the mention
        ("v", "r8", "top", True, "@bob", 8, "@mario.rossi x"),      # token stops at '.'
        ("v", "r9", "top", True, "@mario", 9, "a"),
        ("v", "r10", "top", True, "@zed", 10, "@mario.x"),
    ]
    got = infer(spark, rows)
    assert got["r3"] == "r2"
    assert got["r4"] == "top"
    assert got["r5"] == "top"
    assert got["r7"] == "r1"
    assert got["r8"] == "top"       # mario posts only later (minute 9)
    assert got["r10"] == "r9"
    assert got["top"] is None


def test_equal_and_null_timestamps(spark):
    rows = [
        ("v", "top", None, False, "@h", 0, "x"),
        ("v", "a1", "top", True, "@amy", 5, "a"),
        ("v", "b1", "top", True, "@bob", 5, "@amy same minute"),    # equal ts is not earlier
        ("v", "a2", "top", True, "@amy", None, "no time"),
        ("v", "b2", "top", True, "@bob", 9, "@amy later"),          # a2 has no time -> a1
        ("v", "b3", "top", True, "@bob", None, "@amy no time"),     # reply without time never matches
        ("v", "e1", "top", True, "", 10, "empty author"),
        ("v", "b4", "top", True, "@bob", 11, "@zzz unknown"),       # '' handle is a prefix of anything
    ]
    got = infer(spark, rows)
    assert got["b1"] == "top"
    assert got["b2"] == "a1"
    assert got["b3"] == "top"
    assert got["b4"] == "e1"


def reference_depth(parent, is_reply):
    top = {c for c, r in is_reply.items() if not r}
    out = {}
    for cid in parent:
        d, seen, cur = 0, set(), cid
        while cur in parent and cur not in top and cur not in seen:
            seen.add(cur)
            cur = parent[cur]
            d += 1
        out[cid] = d
    return out


def test_depth_chains_orphans_cycles(spark):
    rows = [("v", "t", None, False, "x", 0, "root text")]
    rows += [("v", f"c{i}", "t" if i == 0 else f"c{i-1}", True, "x", i + 1, f"c{i}") for i in range(130)]
    rows += [("v", "o1", "missing", True, "x", 1, "orphan"), ("v", "o2", "o1", True, "x", 2, "orphan child")]
    rows += [("v", "y1", "y2", True, "x", 1, "cyc1"), ("v", "y2", "y1", True, "x", 2, "cyc2"),
             ("v", "y3", "y1", True, "x", 3, "into cycle")]
    rows += [("w", "n1", None, True, "x", 1, "reply without parent"), ("w", "n2", "n1", True, "x", 2, "n2")]
    df = rows_df(spark, rows).withColumn("inferred_parent_id", F.col("parent_comment_id"))
    got = {(r[0], r[1]): r[2] for r in threads.thread_depth(df).collect()}
    for vid in ("v", "w"):
        sub = [r for r in rows if r[0] == vid]
        parent = {r[1]: r[2] for r in sub}
        exp = reference_depth(parent, {r[1]: r[3] for r in sub})
        assert {c: got[(vid, c)] for c in parent} == exp
    assert got[("v", "c129")] == 130
    assert got[("v", "y3")] == 3


def test_context_columns(spark):
    rows = [("v", "t", None, False, "x", 0, "head"), ("v", "a", "t", True, "x", 1, "A"),
            ("v", "b", "a", True, "x", 2, "B"), ("v", "o", "gone", True, "x", 3, "O")]
    df = rows_df(spark, rows).withColumn("inferred_parent_id", F.col("parent_comment_id"))
    ctx = threads.context_columns(df, threads.thread_depth(df))
    got = {r["comment_id"]: (r["head_comment_text"], r["previous_comment_text"]) for r in ctx.collect()}
    assert got == {"t": (None, None), "a": ("head", None), "b": ("head", "A"), "o": (None, None)}


def walked_depth(rows):
    """Hops along parents until a top-level comment, an unknown id or a repeat; where the walk stops."""
    by_id = {c: (p, r) for c, p, r in rows}
    out = {}
    for c, p, r in rows:
        cur, seen, d = c, set(), 0
        while cur in by_id and by_id[cur][1] and by_id[cur][0] is not None and cur not in seen:
            seen.add(cur)
            cur, d = by_id[cur][0], d + 1
        out[c] = (d, cur)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_depths_of_random_graphs_with_cycles(spark, seed):
    import random
    rng = random.Random(seed)
    n = 60
    rows = [(f"c{i}", rng.choice([None, "gone"]) if rng.random() < 0.1 else f"c{rng.randrange(n)}", rng.random() < 0.93)
            for i in range(n)]
    rows = [(c, p, r and p is not None) for c, p, r in rows]
    df = spark.createDataFrame([("v", c, p, r) for c, p, r in rows], "video_id string, comment_id string, "
                               "inferred_parent_id string, is_reply boolean")
    got = {r.comment_id: (r.depth, r.root_id) for r in threads.thread_depth(df).collect()}
    assert got == walked_depth(rows)


def test_long_chain_into_a_long_cycle(spark):
    rows = [(f"c{i:04d}", f"c{i - 1:04d}", True) for i in range(1, 300)] + [("c0000", "c0100", True)]
    df = spark.createDataFrame([("v", c, p, r) for c, p, r in rows], "video_id string, comment_id string, "
                               "inferred_parent_id string, is_reply boolean")
    got = {r.comment_id: (r.depth, r.root_id) for r in threads.thread_depth(df).collect()}
    assert got == walked_depth(rows)


def test_last_row_of_a_repeated_id_counts(spark):
    df = spark.createDataFrame([("v", "a", None, False, "z old", 1), ("v", "a", None, False, "b new", 2),
                                ("v", "b", "a", True, "reply", 3)],
                               "video_id string, comment_id string, inferred_parent_id string, is_reply boolean, text string, n int")
    ctx = threads.context_columns(df, threads.thread_depth(df, arrival="n"), arrival="n")
    assert {r.head_comment_text for r in ctx.filter("comment_id = 'b'").collect()} == {"b new"}
