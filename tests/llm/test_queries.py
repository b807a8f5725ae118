"""The registered queries over a small folder of tables, against the brute force of the operators' tests."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadwatch.llm.queries import ORACLES, QUERIES

from test_pages_vectors_urls import nearest_brute_force
from test_text_operators import license_brute_force, tricky_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(4)
    item = "A question of twelve plain words that some document holds as it is, really."
    docs = [*tricky_rows(), (60, f"before all {item} and after", "en", "s", 9), (61, "Under the MIT License, CC BY-NC.", "en", "s", 9)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, int(i % 3 > 0), 0) for i in range(21)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item), (2, "another question that nobody holds in any document at all")], "item_id long, text string"),
        "pages": ([(1, "http://a.net/x", "<article><p>One paragraph of a text.</p></article><footer>(c)</footer>"),
                   (2, None, None)], "page_id long, url string, html string"),
        "embeddings": ([(i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(120)],
                       "vec_id long, embedding array<float>, label int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at, docs, tables


def test_queries(spark, folder):
    at, docs, tables = folder
    rows = {n: q(spark, at).collect() for n, q in QUERIES.items() if n not in ORACLES}
    assert {(r.doc_id, r.item_id) for r in rows["op1_benchmark_decontamination"]} == {(60, 1)}
    quality = rows["op3_quality_classifier"]
    assert len(quality) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in quality)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in quality if r.doc_id is not None)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows["op4_license_scan"]) == \
        Counter((d[0], *license_brute_force(d[1])) for d in docs)
    import public_tokenizers
    from tokenizers import Tokenizer
    bpe, word = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    counted = [(d[0], len((d[1] or "").encode()), len(bpe.encode(d[1] or "", add_special_tokens=False).ids)) for d in docs]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows["op5_token_counts"]) == \
        Counter((*c, c[2] > 512) for c in counted)
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in rows["op7_min_cut_main_text"]} == \
        {1: ("http://a.net/x", "One paragraph of a text.", 24), 2: (None, "", 0)}
    exact = {(q, i) for q, _, i, _ in nearest_brute_force([r[:2] for r in tables["embeddings"][0]], 20)}
    found = {(r.query_id, r.vec_id) for r in rows["op8_rotated_codes_ann"]}
    assert len(found) == len(exact) and len(found & exact) >= 0.95 * len(exact)
    tokens = rows["op11_direct_token_files"]
    assert Counter((r.doc_id, r.n_tokens) for r in tokens) == Counter((c[0], c[2] + 1) for c in counted)
    assert sorted(r.start for r in tokens) == np.cumsum([0, *(r.n_tokens for r in sorted(tokens, key=lambda r: r.start))])[:-1].tolist()
    aligned = rows["op12_shared_cut_alignment"]
    assert Counter(r.doc_id for r in aligned) == Counter(d[0] for d in docs)
    assert all(0 < r.n_groups <= min(r.n_a, r.n_b) and r.n_links >= max(r.n_a, r.n_b) for r in aligned if r.n_a)
    assert sum(r.n_a > 0 for r in aligned) > len(docs) / 2
    total = sum(len(word.encode(d[1] or "", add_special_tokens=False).ids) + 1 for d in docs)
    assert sum(r.length for r in rows["op9_best_fit_packing"]) == total


def test_oracles_agree(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    at, docs, _ = folder
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        where = "WHERE doc_id IS NOT NULL AND doc_id <> 2" if t == "documents" else ""
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet') {where}")
    clean = f"{at}-clean"
    spark.read.parquet(f"{at}/documents.parquet").filter("doc_id <> 2").write.parquet(f"{clean}/documents.parquet")
    for t in ("pages", "embeddings"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(f"{clean}/{t}.parquet")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, clean)
        exp = con.sql(sql)
        assert sorted(got.columns) == sorted(exp.columns)
        order = sorted(got.columns)
        assert Counter(tuple(r[c] for c in order) for r in got.collect()) == \
            Counter(tuple(r) for r in con.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall()), name


def test_every_operator_is_registered_once():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
