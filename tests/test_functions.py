"""Column expressions against hand-made cases (ties, nulls, Unicode)."""

import math

import pytest
from pyspark.sql import functions as F

from threadwatch.functions import scoring, taxonomy, text


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_parse_label_cases(spark):
    cases = {"Sì": 1, "sì, anzi no": 0, "no. Sì": 1, "si": 1, "si!": 1, "si.": 1, "sicuro": None,
             "così": None, "noto": None, "": None, "   ": None, "  NO  ": 0, "Direi di no": 0, "SÌ!": 1,
             "sì? no": 0, "Forse": None}
    got = one_col(spark, list(cases), text.parse_label)
    assert got == list(cases.values())
    assert one_col(spark, [None], text.parse_label) == [None]


def test_parse_topic_cases(spark):
    cases = {
        "politics and government": "politics and government",
        "POLITICS AND GOVERNMENT": "politics and government",
        "coup d’etat": "conflict, war and peace",
        "La categoria è: sport.": "sport",
        "si parla di climate change": "environment",
        "education e health": "education",  # both contained: the longer category key wins
        "nulla": None,
        "": None,
        "  crime  ": "crime, law and justice",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, v string")
    got = [r[0] for r in taxonomy.with_parsed_topic(df, "v").orderBy("i").select("topic").collect()]
    assert got == list(cases.values())


def test_canonical_topic(spark):
    vals = ["Crime", "sport", "made up", None]
    assert one_col(spark, vals, taxonomy.canonical_topic) == ["crime, law and justice", "sport", "made up", None]


def test_taxonomy_shape():
    rows = taxonomy.taxonomy_rows()
    assert sum(1 for r in rows if r[0] == "category") == 17
    assert sum(1 for r in rows if r[0] == "instance") == 131
    assert taxonomy.taxonomy_block().splitlines()[0].startswith("- arts, culture, entertainment and media (es.: ")


def test_handles_and_mentions(spark):
    assert one_col(spark, ["@@Bob!?", "Mario,", "", None], text.norm_handle) == ["bob", "mario", "", None]
    vals = ["@Bob, hi", "@mario.rossi ciao", " @Anna", "​@ann x", "hello @bob", "@", None]
    assert one_col(spark, vals, text.leading_mention) == ["bob", "mario", "anna", "ann", None, None, None]


def test_truncate_description(spark):
    d1000 = "a" * 999 + "."
    d1001_dot = "x" * 500 + "." + "y" * 500
    d1001_nodot = "z" * 1001
    got = one_col(spark, [d1000, d1001_dot, d1001_nodot, None], lambda c: text.truncate_description(c, 1000))
    assert got == [d1000, "x" * 500 + ".", "z" * 1000, None]


def test_clean_text(spark):
    vals = ["ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne", "a​b‌c‍d﻿e", "  many \n\t spaces  ", "no break", None, "   "]
    got = one_col(spark, vals, text.clean_text)
    assert got == ["full width", "fine", "abcde", "many spaces", "no break", None, ""]


def test_mask_mentions(spark):
    vals = ["ciao @author_12 e @mario!", "@author_3x resta", "mail a@b.it"]
    assert one_col(spark, vals, text.mask_unknown_mentions) == [
        "ciao @author_12 e @user", "@user resta", "mail a@user"]


def test_offensive_score(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (4, 4), (3, 3), (10, 1)], "n long, k long")
    got = [round(r[0], 6) for r in df.select(scoring.offensive_score(F.col("n"), F.col("k"))).collect()]
    expect = [0.0, 0.0, 0.747371, 0.716911, round(math.atan(0.1) / (math.pi / 2), 6)]
    assert got == expect
    trig = df.select(scoring.offensive_trigger(scoring.offensive_score(F.col("n"), F.col("k")))).collect()
    assert [r[0] for r in trig] == [0, 0, 1, 1, 0]


def test_uniform_matches_known_value(spark):
    df = spark.createDataFrame([("7",)], "k string")
    assert df.select(scoring.uniform(F.col("k"), 42)).first()[0] == pytest.approx(2903997543 / 2 ** 32)


def test_topic_udf_path_agrees_with_expression(spark):
    vals = ["politics and government", "coup d’etat", "La categoria è: sport.", "education e health",
            "nulla", "", None, "  crime  ", "un disaster e un accident and emergency incident",
            "law enforcement and justice and religion", "Weather Forecast oggi"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    keys = [(k, c) for _, k, c in taxonomy._decision_order()]
    a = []
    for v in vals:
        t = " ".join((v or "").lower().replace("\u2019", "'").split())
        exact = taxonomy.CAT_BY_KEY.get(t) or taxonomy.INST_BY_KEY.get(t)
        a.append(exact or next((c for k, c in keys if t and k in t), None))
    b = [r[0] for r in taxonomy.with_parsed_topic(df, "v").orderBy("i").select("topic").collect()]
    assert a == b


def test_taxonomy_keys_are_normalised():
    for _, key, _ in taxonomy._decision_order():
        assert key == " ".join(key.lower().split()) and "\u2019" not in key
