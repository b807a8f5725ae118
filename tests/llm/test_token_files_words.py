"""Token files: letters that are known are not tokenised again, whatever marks or line feeds stand by them."""

from __future__ import annotations

import random

import numpy as np

from threadwatch.llm import op11_token_files as op11
from threadwatch.llm.pieces import model_path


def library(encoder, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in encoder.pieces.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_known_letters_are_not_tokenised_again():
    encoder = op11.WordIds(model_path(op11.VOCABULARY))
    asked, sent = [], []
    tokenize, ids = encoder.tokenize, encoder._ids
    encoder.tokenize = lambda t: asked.append(t) or tokenize(t)
    encoder._ids = lambda t: sent.append(t) or ids(t)
    texts = ["The stone wall stone, stone. wall!\nNext wall?!", "A Straße Straße, Straße.\nÉté stone"]
    assert encoder.encode(texts) == library(encoder, texts)
    assert asked == ["Ġstone", "Ġwall", encoder.pieces._shown(" Straße")]
    assert sent == ["The", "A"]
    assert not any("\n" in w for w in encoder.young)


def test_line_feeds_and_marks(monkeypatch):
    rng = random.Random(8)
    parts = ["a", "the", "né", "Ab", "wordy", "ª", "ÿ", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\r", "　", "\x1c", "\x85", "\xa0", "12", ".", ",",
             "!?", "'s", "'", "你", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 16))) for _ in range(8000)]
    encoder = op11.WordIds(model_path(op11.VOCABULARY))
    monkeypatch.setattr(op11, "REMEMBERED", 300)
    monkeypatch.setattr(op11, "PARTS", 20)
    want = library(encoder, texts)
    for a in range(0, len(texts), 40):
        assert encoder.encode(texts[a:a + 40]) == want[a:a + 40]
    encoder.encode([" ".join(f"end.\nNext{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))])
    assert len(encoder.pieces.parts) <= 22
