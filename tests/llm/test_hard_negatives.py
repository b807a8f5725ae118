"""Strassen products and hard negatives against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from threadwatch.llm import op13_hard_negatives as op13


@pytest.mark.parametrize("m, k, n, leaf", [(1, 1, 1, 1), (2, 2, 2, 1), (7, 5, 3, 1), (33, 64, 47, 4), (100, 3, 90, 2),
                                           (64, 64, 64, 16), (5, 0, 4, 1), (0, 4, 3, 1), (129, 65, 127, 8)])
def test_product(m, k, n, leaf):
    rng = np.random.default_rng(m * 1000 + k * 10 + n)
    for top in (300, 2**31):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        exact = a.astype(object) @ b.astype(object) if k else np.zeros((m, n), object)
        fits = np.vectorize(lambda x: (int(x) + 2**63) % 2**64 - 2**63, otypes=[np.int64])(exact) if m * n else exact.astype(np.int64)
        assert np.array_equal(op13.strassen(a, b, leaf), fits)


def brute(rows, is_anchor, window=(50, 95), n_pos=5, n_neg=3):
    """Rows (vec_id, label, vector) taken one by one."""
    ready = set()
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not np.isfinite(x) for x in v) or not v:
            continue
        ready.add((i, label, tuple(int(np.floor(256 * np.float64(x))) for x in v)))
    out = []
    for i, label, v in ready:
        if not is_anchor(i):
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, lab) for j, lab, w in ready if j != i and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2] == label][:n_pos]:
            near = [o for o in others if o[2] != label and window[0] * -s <= 100 * -o[0] <= window[1] * -s][:n_neg]
            out += [(i, j, r, o[1], -s, -o[0]) for r, o in enumerate(near, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, score string, part int, key int, rank int, rows int, anchors int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3, 4, 5) for i, label, v in rows], SCHEMA)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [np.float32(rng.gauss(0, 1) + (i % 3)).item() for _ in range(9)]) for i in range(300)]
    rows += [(i, rng.randrange(3), [0.5, 0.25]) for i in range(300, 340)]  # ties of another dimension
    rows += [rows[10], rows[10], (50, 1, rows[3][2]), (50, 1, [1.0] * 9), (None, 1, [1.0] * 9), (400, None, [1.0] * 9),
             (401, 1, None), (402, 1, []), (403, 1, [float("nan")] * 9), (404, 1, [float("inf")] * 9), (405, 1, [None] * 9),
             (406, 2, [0.0] * 9), (450, 2, [-1.0] * 9), (407, 1, [3e38] * 9)]
    usable = [r for r in rows if r[0] != 407]  # too long for 64 bits
    got = op13.mine(table(spark, rows).repartition(3), row_block=64, anchor_block=3)
    expected = brute(usable, lambda i: i % 50 == 0)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 40
    wide = op13.mine(table(spark, rows), is_anchor=F.col("vec_id") % 7 == 0, n_positives=2, n_negatives=4, window=(0, 120))
    assert sorted(map(tuple, wide.collect())) == brute(usable, lambda i: i % 7 == 0, (0, 120), 2, 4)


def test_ties_copies_and_empty(spark):
    same = [(i, i % 2, [0.1, 0.2, 0.3]) for i in range(120)]  # every vector alike
    got = op13.mine(table(spark, same), row_block=16, window=(50, 100))
    assert sorted(map(tuple, got.collect())) == brute(same, lambda i: i % 50 == 0, (50, 100))
    assert op13.mine(table(spark, same)).count() == 0  # no score lies below its equals
    assert op13.mine(table(spark, [])).collect() == []
    alone = [(0, 1, [1.0]), (3, 2, [0.7])]  # an anchor without a positive
    assert op13.mine(table(spark, alone)).collect() == []


def test_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.randrange(5), [rng.gauss(0, 0.4) + 0.1 for _ in range(8)]) for i in range(400)]
    rows += [(1000, None, [0.0] * 8), (1050, 2, None), (1100, 1, [float("nan")] * 8)]
    table(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = op13.op13_strassen_hard_negatives(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    sql = con.execute(op13.OP13_SQL)
    names = [c[0] for c in sql.description]
    expected = sorted(sql.fetchall())
    assert df.columns == names and sorted(map(tuple, df.collect())) == expected and len(expected) > 50
