"""Token files are read back some documents at a time, and plain words skip the tokenizer's whole pipeline."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from threadwatch.llm import op11_token_files as op11
from threadwatch.llm.pieces import model_path


def test_files_are_read_back_in_slices(monkeypatch):
    ids = np.random.default_rng(1).integers(0, 50_000, 30_000).astype("<u4")
    lengths = [1] * 500 + [0, 9000, 0, 1] + [20] * 1000 + [499]
    assert sum(lengths) == len(ids)
    content = op11.file_bytes(list(range(len(lengths))), lengths, ids, 0, 0)
    asked = []
    between = op11.TokenFile.between
    monkeypatch.setattr(op11, "READ_IDS", 1000, raising=False)
    monkeypatch.setattr(op11.TokenFile, "between", lambda f, a, b: asked.append(b - a) or between(f, a, b))
    batch = pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])
    got = pa.Table.from_batches(op11._documents(iter([batch])))
    edges = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    assert got["at"].to_pylist() == edges[:-1] and got["n_tokens"].to_pylist() == lengths
    assert got["ids_crc32"].to_pylist() == [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(edges, edges[1:])]
    assert max(asked) <= 9000 and sorted(asked)[-2] <= 1000


def test_plain_words_go_to_the_model():
    encoder = op11.WordIds(model_path(op11.VOCABULARY))
    tokenizer = encoder.pieces.tokenizer
    text = "Plain words, été and (odd) ones: don't 12.\nNext line ends."
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    learned = []
    ids = encoder._ids
    encoder._ids = lambda t: learned.append(t) or ids(t)
    assert encoder.encode([text]) == [want]
    assert learned == ["Plain", " (odd)", " don't", " 12.\nNext"]
