"""Token files: exact round trip, random access, order and odd texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadwatch.llm import op11_token_files as op11
from threadwatch.llm.pieces import model_path

ODD = ["", " ", "  ", "   ", "a", " a", "a ", "  a  b   c ", "a\n b", "a \n b", "\n\n a\n", "a\t\tb  c", "x　 y\x85z \x1c w", "\x1c \x1d a",
       "end <|endoftext|> more  <|endoftext|>x", "<|endoftext|>", "don't we'll it's 12 345 a1b2 ?! ...", "ümläut 你好 世界 🙂 é",
       "a" * 300 + " " + "b" * 70, "Ġ odd Ċ", " ​ a", "\xa0 a \xa0b", "one\ntwo\r\nthree \r\n four", "  a b", "a  "]


def library(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(model_path(op11.VOCABULARY))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def tangled(rng):
    parts = ["a", "the", "né", " ", " ", "  ", "\n", "\t", "12", ".", "'s", "<|endoftext|>", "\x1c", "　", "你", "Ab", "wordy"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))


def test_ids_are_those_of_the_library(monkeypatch):
    rng = random.Random(3)
    texts = ODD + [tangled(rng) for _ in range(6000)]
    expected = [np.array(ids[:-1], "<u4").tobytes() for ids in library(texts)]
    monkeypatch.setattr(op11, "LONG_TEXT", 5)
    monkeypatch.setattr(op11, "REMEMBERED", 200)
    encoder = op11.WordIds(model_path(op11.VOCABULARY))
    for a in range(0, len(texts), 50):
        assert encoder.encode(texts[a:a + 50]) == expected[a:a + 50]
    words = op11.WordIds(model_path("word_bpe_49k.json"))  # not cut: another pipeline
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(model_path("word_bpe_49k.json"))
    assert words.encode(["Some  words here.", ""]) == [np.array(plain.encode("Some  words here.", add_special_tokens=False).ids, "<u4").tobytes(), b""]


@pytest.mark.parametrize("top", [1, 2, 255, 256, 65535, 65536, 2**24, 2**32 - 1])
def test_codes(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        ids = rng.integers(0, top, n, endpoint=True, dtype=np.uint64)
        ids[rng.random(n) < 0.6] %= 300
        lengths = [n // 3, 0, n - n // 3]
        f = op11.TokenFile(op11.file_bytes([7, None, -3], lengths, ids, 5, 6) + b"\n")
        assert (len(f), f.n_docs, f.range, f.number) == (n, 3, 5, 6)
        assert f.doc_ids[f.known].tolist() == [7, -3] and f.known.tolist() == [True, False, True]
        assert f.between(0, n).tolist() == ids.tolist()
        assert [f[int(i)] for i in rng.integers(0, n, 40)] if n else True
        for i in rng.integers(0, n, 60) if n else []:
            assert f[int(i)] == int(ids[i])
        for a, b in np.sort(rng.integers(0, n, (40, 2), endpoint=True), axis=1):
            assert f.between(int(a), int(b)).tolist() == ids[a:b].tolist()
        assert [f.document(k).tolist() for k in range(3)] == [ids[:n // 3].tolist(), [], ids[n // 3:].tolist()]
        with pytest.raises(IndexError):
            f[n]
    with pytest.raises(ValueError):
        op11.TokenFile(b"other" * 20)


def expected_rows(rows):
    start, out = 0, []
    for (i, _), ids in zip(rows, library([t for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, docs, clashing, nothing, tmp_path):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    for n, (df, sizes) in enumerate([(docs, {}), (clashing, {"file_ids": 700, "range_bytes": 9000})]):
        path = f"{tmp_path}/tokens{n}"
        op11.write_token_files(df, path, **sizes)
        got = sorted((tuple(r) for r in op11.read_documents(spark, path).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == [r[0] for r in rows]
        assert sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in got) == \
            sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in expected_rows(rows))
        assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
        manifest = spark.read.parquet(f"{path}/manifest").orderBy("start").collect()
        assert (len(manifest) > 4) == bool(sizes)
        assert [m.start + m.n_ids for m in manifest] == [m.start for m in manifest[1:]] + [sum(r[2] for r in got)]
        by_crc = {r[3]: ids for r, ids in zip(expected_rows(rows), library([t for _, t in rows]))}
        whole = [i for r in got for i in by_crc[r[3]]]
        rng = random.Random(n)
        asked = [0, len(whole) - 1, len(whole), -1] + [rng.randrange(len(whole)) for _ in range(200)]
        places = spark.createDataFrame([(p,) for p in asked] + [(None,)], "place long")
        assert sorted(map(tuple, op11.tokens_at(spark, path, places).collect())) == \
            sorted({(p, whole[p]) for p in asked if 0 <= p < len(whole)})
    path = f"{tmp_path}/none"
    op11.write_token_files(nothing, path)
    assert op11.read_documents(spark, path).collect() == []


def test_repeated_rows_spread(spark, tmp_path):
    rows = spark.range(400).select(F.lit(5).alias("doc_id"), F.lit("the same words again and again").alias("text")).repartition(5)
    path = f"{tmp_path}/same"
    op11.write_token_files(rows, path, range_bytes=1500)
    files = spark.read.parquet(f"{path}/manifest").collect()
    assert len(files) > 4 and sum(f.n_docs for f in files) == 400
    got = op11.read_documents(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == [n * got[0].n_tokens for n in range(400)]
