"""Encoding texts piece by piece with the installed ``tokenizers`` library.

A text is cut at boundaries that no token can cross, so that the pieces' tokens,
put together, are the text's tokens.  Pieces recur; each Python worker remembers
the tokens of a bounded number of them and encodes the others in batches balanced
by bytes.  A piece of Latin letters and ASCII punctuation goes straight to the BPE
model, which is what the whole tokenizer would do with it, without the cost of a
full encoding; any other piece is encoded by the tokenizer as a text of its own.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
from array import array

from threadwatch.llm.workers import begin, kept

BATCH_BYTES = 1 << 18
REMEMBERED = 600_000
LONG_PIECE = 64

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: letters then ASCII punctuation other than the apostrophe: one or two pre-tokens (and no special token,
#: as those have punctuation before letters)
_PLAIN = re.compile(rf"([\n ]?)([{_LATIN}]+)([!-&(-/:-@\[-`{{-~]*)")
_CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")
#: a text with none of these is cut by plain string operations
_IRREGULAR = re.compile(r"\s\s|[^\S \n]|\x01|^\s")


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def model_path(name_or_path: str) -> str:
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers
    return public_tokenizers.path(name_or_path)


class Encoder:
    """Tokens of pieces; one per Python worker and vocabulary file."""

    _made: dict[str, "Encoder"] = kept({})

    @classmethod
    def of(cls, name: str) -> "Encoder":
        if name not in cls._made:
            cls._made[name] = cls(model_path(name))
        return cls._made[name]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.table = "".join(self.letters)
        self.parts: dict[str, bytes] = {}
        self.ascii = str.maketrans({chr(b): self.letters[b] for b in range(128)})
        #: the two pipelines that the direct way knows; any other vocabulary is encoded by the tokenizer alone
        kind = spec.get("pre_tokenizer") or {}
        self.byte_level = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and not spec["normalizer"]
        self.lower_words = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])] == \
            ["NFC", "Replace", "Lowercase"]

    def _shown(self, piece: str) -> str:
        if piece.isascii():
            return piece.translate(self.ascii)
        return codecs.charmap_decode(piece.encode(), "strict", self.table)[0]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) > REMEMBERED // 2:
                self.parts.clear()
            ids = self.parts[part] = _packed([t.id for t in self.model.tokenize(self._shown(part))])
        return ids

    def _direct(self, piece: str) -> bytes | None:
        m = _PLAIN.fullmatch(piece)
        if m is None or len(piece) > LONG_PIECE:
            return None
        space, letters, marks = m.groups()
        if self.lower_words:
            ids = self._part(letters.lower())
        elif self.byte_level:
            ids = self._part(" " + letters) if space == " " else (self._part(space) if space else b"") + self._part(letters)
        else:
            return None
        return ids + self._part(marks) if marks else ids

    def encode(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of every piece, as unsigned 32-bit numbers; the tokenizer gets pieces in batches of ``BATCH_BYTES``."""
        out, batch, size = {}, [], 0

        def flush():
            for p, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                out[p] = _packed(e.ids)
            batch.clear()

        for p in pieces:
            ids = self._direct(p)
            if ids is not None:
                out[p] = ids
                continue
            batch.append(p)
            size += len(p)
            if size >= BATCH_BYTES:
                flush()
                size = 0
        if batch:
            flush()
        return out


class Memory:
    """What a Python worker remembers of pieces: at most ``REMEMBERED`` of them, none longer than ``LONG_PIECE``."""

    _made: dict[tuple, "Memory"] = kept({})

    @classmethod
    def of(cls, *purpose) -> "Memory":
        begin("pieces", *purpose)
        return cls._made.setdefault(purpose, cls())

    def __init__(self):
        self.known: dict = {}

    def lookup(self, texts: list[list], learn) -> dict:
        """A dict that has every piece of ``texts``; ``learn(missing)`` gives the values of new pieces."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        missing = set().union(*texts) - known.keys()
        found = learn(missing)
        if all(len(p) <= LONG_PIECE for p in missing):
            known.update(found)
            return known
        known.update((p, v) for p, v in found.items() if len(p) <= LONG_PIECE)
        return known | {p: v for p, v in found.items() if len(p) > LONG_PIECE}


def space_led_pieces(text: str) -> list[str]:
    """Pieces of a text for a byte-level vocabulary: cut before white space that follows other characters."""
    if _IRREGULAR.search(text):
        return _CUT.split(text)
    words = text.replace("\n", " \x01").split(" ")
    return words[:1] + ["\n" + w[1:] if w[:1] == "\x01" else " " + w for w in words[1:]]
