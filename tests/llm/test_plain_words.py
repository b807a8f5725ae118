"""Codes of plain words, read off the bytes of a batch, are those that ``word_code`` gives one by one."""

from __future__ import annotations

import random

import pyarrow as pa

from threadwatch.llm import op1_decontamination as op1
from threadwatch.llm.words import Words


def test_plain_words_have_the_codes_of_single_words():
    r = random.Random(7)
    letters = "abcdefghABCéÉßÿÀÖ×÷ØÞ"
    words = ["".join(r.choice("\"'([.,$") for _ in range(r.randint(0, 10))) + "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
             + "".join(r.choice(".,!?;:\"')]}%$") for _ in range(r.randint(0, 10))) for _ in range(5000)]
    words += ["".join(r.choice(letters + "019_-'’»€Ωı\x7f.,") for _ in range(r.randint(1, 20))) for _ in range(5000)]
    words += [x + e for w in [*op1.UNITS, *op1._NUMBER_WORDS] for x in (w, w.title(), w.upper(), "3" + w) for e in ("", ".", ",\"")]
    words = [w for w in words if w]
    for texts in (words, [" ".join(words)], ["a"], ["é"], ["."], ['"' * 20 + "a" + "." * 20], [""], []):
        split = Words(pa.array(texts, pa.string()))
        assert op1._codes(split).tolist() == op1._learn([split.text(i) for i in range(len(split))])


def test_plain_words_are_not_remembered():
    op1._SEEN.clear()
    op1._codes(Words(pa.array(["Plain (words), été! and signs$$$ of thirty letters: abcdefghijklmnopqrstuvwxyzabcd. 12 km"])))
    assert len(op1._SEEN) == 3  # thirty, 12, km
