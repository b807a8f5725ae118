"""Pseudonyms, name replacement (broadcast and chunked paths) and exact distributed ranks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadwatch.operators import privacy
from threadwatch.operators.ranking import rank_within


def test_rank_within_matches_row_number_under_skew(spark):
    # one group holds 40 % of rows, many keys repeat (ties broken by id)
    df = spark.range(3000).select(
        F.when(F.col("id") % 5 < 2, F.lit("hot")).otherwise((F.col("id") % 37).cast("string")).alias("g"),
        (F.col("id") % 97).cast("double").alias("v"), F.col("id"))
    got = rank_within(df, F.col("v"), ["id"], ["g"], "r")
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = df.withColumn("r2", F.row_number().over(w) - 1)
    bad = got.join(exp, ["g", "id"]).filter(F.col("r") != F.col("r2")).count()
    assert bad == 0


def test_pseudonyms_dense_and_continue_existing(spark):
    rows = [("@b", 3), ("@a", 1), ("@c", 2), ("@a", 5), ("@d", 2)]
    c = spark.createDataFrame(rows, "author string, published_at long")
    existing = spark.createDataFrame([("@c", "author_0")], "author string, author_anon string")
    m = {r[0]: r[1] for r in privacy.assign_pseudonyms(privacy.first_appearance(c), existing).collect()}
    assert m == {"@c": "author_0", "@a": "author_1", "@d": "author_2", "@b": "author_3"}
    assert len(set(m.values())) == len(m)


def test_replace_names_longest_first_and_chunked(spark):
    names = spark.createDataFrame([("Bob", "author_1"), ("Bobby", "author_2"), ("Al", "author_3")],
                                  "author string, author_anon string")
    texts = spark.createDataFrame([(1, "Bobby and Bob met Al"), (2, "nobody"), (3, None)], "i int, t string")
    one = {r[0]: r[1] for r in privacy.replace_names(texts, "t", names).collect()}
    assert one == {1: "@author_2 and @author_1 met @author_3", 2: "nobody", 3: None}
    assert privacy.replace_names(texts.limit(0), "t", names).collect() == []
    assert {r[0]: r[1] for r in privacy.replace_names(texts, "t", names.limit(0)).collect()} == \
        {1: "Bobby and Bob met Al", 2: "nobody", 3: None}


def test_replace_authors(spark):
    df = spark.createDataFrame([("@x",), ("@y",)], "author string")
    m = spark.createDataFrame([("@x", "author_9")], "author string, author_anon string")
    assert sorted(r[0] for r in privacy.replace_authors(df, m).collect()) == ["@y", "author_9"]


def test_replace_handle_names_longest_prefix(spark):
    names = spark.createDataFrame([("@bob", "author_1"), ("@bobby", "author_2"), ("@al", "author_3"),
                                   ("free name", "author_4")], "author string, author_anon string")
    texts = spark.createDataFrame([(1, "@bobby, ask @bob and @al!"), (2, "mail a@alice.it"), (3, None),
                                   (4, "no handles"), (5, "@@bob@bobx @zed"), (6, "")], "i int, t string")
    got = {r[0]: r[1] for r in privacy.replace_handle_names(texts, "t", names, "i").collect()}
    assert got == {1: "@author_2, ask @author_1 and @author_3!", 2: "mail a@author_3ice.it", 3: None,
                   4: "no handles", 5: "@@author_1@author_1x @zed", 6: ""}
    # same result as the automaton path on @-names
    at_only = names.filter("author LIKE '@%'")
    via_ac = {r[0]: r[1] for r in privacy.replace_names(texts, "t", at_only).collect()}
    assert via_ac == got


def test_no_author_is_lost_and_keys_keep_their_type(spark):
    big = 2 ** 60
    rows = [(f"a{i:03d}", big + 200 - i) for i in range(200)] + [("nobody", None), ("b", big + 7), ("c", big + 7)]
    df = spark.createDataFrame(rows, "author string, published_at long")
    got = {r.author: int(r.author_anon.split("_")[1]) for r in privacy.assign_pseudonyms(privacy.first_appearance(df)).collect()}
    expected = sorted({a for a, _ in rows}, key=lambda a: (dict(rows)[a] is None, dict(rows)[a] or 0, a))
    assert got == {a: n for n, a in enumerate(expected)}
    existing = spark.createDataFrame([("c", "author_0")], "author string, author_anon string")
    more = {r.author: r.author_anon for r in privacy.assign_pseudonyms(privacy.first_appearance(df), existing).collect()}
    assert len(more) == 203 and len(set(more.values())) == 203 and more["c"] == "author_0" and more["nobody"] == "author_202"


def test_one_tied_key_and_one_hot_group_spread_over_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id"), F.when(F.col("id") % 3 == 0, "hot")
                                  .otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"))
    flat = rank_within(df, F.col("k"), ["id"], None, "r")
    assert [r.r for r in flat.orderBy("id").collect()] == list(range(4000))
    parts = rank_within(df, F.col("k"), ["id"], ["g"], "r").collect()
    seen = {}
    for r in sorted(parts, key=lambda r: r.id):
        assert r.r == seen.get(r.g, 0)
        seen[r.g] = r.r + 1


def test_names_are_replaced_alike_for_any_chunk_size(spark):
    names = spark.createDataFrame([("Anna Maria", "author_1"), ("Maria Rossi Bianchi", "author_2"), ("Giovanni Verdi", "author_7"),
                                   ("author", "author_8"), ("", "author_9"), ("Ann", "author_3")], "author string, author_anon string")
    texts = spark.createDataFrame([(0, "ciao Anna Maria Rossi Bianchi"), (1, "Giovanni Verdi e author"), (2, None),
                                   (3, "AnnAnna MariaAnn")], "i int, t string")
    expected = {0: "ciao Anna @author_2".replace("Anna", "@author_3a"), 1: "@author_7 e @author_8", 2: None,
                3: "@author_3@author_1@author_3"}
    assert {r.i: r.t for r in privacy.replace_names(texts, "t", names).collect()} == expected


def test_names_against_brute_force(spark, monkeypatch):
    import random

    from threadwatch.operators import spans
    rng = random.Random(6)
    letters = ["a", "b", "ab", "é", "🙂", " "]
    names = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(40)})
    amap = {n: f"author_{i}" for i, n in enumerate(names)}
    texts = ["".join(rng.choice([*letters, "c", "x y"]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]

    def brute(text):
        held = [None] * len(text)
        for name in sorted(names, key=lambda n: (-len(n), n)):
            at = text.find(name)
            while at >= 0:
                if all(h is None for h in held[at:at + len(name)]):
                    held[at:at + len(name)] = [(at, name)] * len(name)
                at = text.find(name, at + 1)
        out, at = [], 0
        while at < len(text):
            out.append(text[at] if held[at] is None else "@" + amap[held[at][1]])
            at += 1 if held[at] is None else len(held[at][1])
        return "".join(out)

    monkeypatch.setattr(spans, "BLOCK", 16)
    for n in (1, 3, 8):  # windows over the ends of blocks
        whole = {(a + i): int(b) for _, a, bits in spans.window_bits("abcdefghij" * 9, [n, 8]) if _ == n for i, b in enumerate(bits)}
        alone = {i: int(next(spans.window_bits(("abcdefghij" * 9)[i:i + n], [n]))[2][0]) for i in range(90 - n + 1)}
        assert whole == alone
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(999, None, "y")], "key int, text string, _hits string") \
        .withColumnRenamed("_hits", "name").repartition(3)
    got = {r.key: r.text for r in privacy.replace_names(rows, "text", spark.createDataFrame(
        [*amap.items(), ("", "author_x"), (None, "author_y"), (names[0], "author_z")], "author string, author_anon string")).collect()}
    assert got == {**{i: brute(t) for i, t in enumerate(texts)}, 999: None}
