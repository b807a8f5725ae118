"""Alignment of two tokenizers against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from threadwatch.llm import op12_alignment as op12
from threadwatch.llm.pieces import _byte_letters, model_path


def brute_groups(a_ends, b_ends):
    cuts = sorted(set(a_ends) & set(b_ends))
    out, a, b = [], 0, 0
    for c in cuts:
        a1, b1 = a_ends.index(c, a) + 1, b_ends.index(c, b) + 1
        out.append((a, a1, b, b1))
        a, b = a1, b1
    return out


def test_groups_and_links():
    rng = random.Random(4)
    for size in [1, 2, 3, 5, 9, 30, 200] * 40:
        a = sorted(rng.sample(range(1, size), rng.randrange(size))) + [size]
        b = sorted(rng.sample(range(1, size), rng.randrange(size))) + [size]
        groups = op12.groups_of(a, b)
        assert groups == brute_groups(a, b)
        links = op12.links_of(a, b, groups)
        spans = [list(zip([0, *ends], ends)) for ends in (a, b)]
        assert links == [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, u) in enumerate(spans[1]) if s < u and t < e]
    assert op12.groups_of([], []) == []
    far = list(range(1, 2001))  # the only shared cut lies at an end
    assert op12.groups_of(far, [1, 2000]) == [(0, 1, 0, 1), (1, 2000, 1, 2)]


class Library:
    """Whole texts as the two libraries encode them."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(model_path(op12.BYTE_VOCABULARY))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path(op12.PIECE_VOCABULARY))
        byte = {c: i for i, c in enumerate(_byte_letters())}
        self.letters = {i: bytes(byte[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in byte for c in t)}

    def piece(self, i):
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(self, text):
        """Ids and ends of both, or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        parts = [self.letters[i] for i in a], [self.piece(i) for i in b]
        if any(b"".join(p) != b" " + text.encode() for p in parts):
            return None
        ends = [list(accumulate(map(len, p))) for p in parts]
        return a, b, *ends

    def rows(self, docs):
        found, held = [], Counter()
        for i, text in docs:
            t = self.tokens(text)
            if t is None:
                found.append((i, None, None, None))
                continue
            a, b, a_ends, b_ends = t
            groups = brute_groups(a_ends, b_ends)
            starts = [0, *a_ends], [0, *b_ends]
            links = [(a[x], b[y]) for a0, a1, b0, b1 in groups for x in range(a0, a1) for y in range(b0, b1)
                     if starts[0][x] < b_ends[y] and starts[1][y] < a_ends[x]]
            held.update(set(links))
            found.append((i, t, groups, links))
        most = defaultdict(int)
        for (x, _), n in held.items():
            most[x] = max(most[x], n)
        out = []
        for i, t, groups, links in found:
            if t is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            a, b = t[:2]
            text = ";".join(",".join(map(str, a[a0:a1])) + "|" + ",".join(map(str, b[b0:b1])) for a0, a1, b0, b1 in groups)
            out.append((i, len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links),
                        sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
        return out, held, most


ODD = ["", " ", "  ", "   ", "a", " a", "a ", "  a  b   c ", "a\n b", "a \n b", "\n\n a\n", "a\t\tb  c", "x　 y\x85z \x1c w", "\x1c \x1d a",
       "end <|endoftext|> more  <|endoftext|>x", "<s> </s> <unk> <0x0A>", "x▁y", "▁", "don't we'll it's 12 345 a1b2 ?! ...",
       "ümläut 你好 世界 🙂 é", "a" * 300 + " " + "b" * 70, "a\x00b", "﻿x", "one\ntwo\r\nthree \r\n four", "fine ▁ lost", "ﬁ ½ Å"]


def tangled(rng):
    parts = ["a", "the", "né", " ", " ", "  ", "\n", "\t", "12", ".", "'s", "<s>", "\x1c", "　", "你", "Ab", "wordy", "🙂"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))


@pytest.fixture(scope="module")
def library():
    return Library()


def test_pieces_give_what_whole_texts_give(library, monkeypatch):
    rng = random.Random(9)
    texts = ODD + [tangled(rng) for _ in range(3000)]
    monkeypatch.setattr(op12, "REMEMBERED", 100)
    monkeypatch.setattr(op12, "TOGETHER", 7)
    aligner = op12.Aligner(model_path(op12.BYTE_VOCABULARY), model_path(op12.PIECE_VOCABULARY))
    expected = library.rows(list(enumerate(texts)))[0]
    for n in range(0, len(texts), 40):
        for (pairs, groups, numbers), want in zip(aligner.align(texts[n:n + 40]), expected[n:n + 40]):
            got = (numbers & 0xFFFFFFFF, numbers >> 32 & 0xFFFFFFFF, numbers >> 64, len(pairs) // 4)
            assert got == want[1:5], texts[want[0]]
            assert (hashlib.sha256(groups.encode()).hexdigest() if numbers else "") == want[7]


def test_documents(spark, docs, clashing, nothing, library):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, held, most = library.rows(rows)
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    for df, size in ((docs, 300), (clashing, 1 << 20)):
        got, pairs = op12.align_documents(df, chunk_bytes=size)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=order) == sorted(expected, key=order)
        assert {(r.a_id, r.b_id): (r["count"], r.best) for r in pairs.collect()} == \
            {p: (n, n == most[p[0]]) for p, n in held.items()}
    assert op12.align_documents(nothing)[0].collect() == []
