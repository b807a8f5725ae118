"""Benchmark decontamination by template canonicalisation.

Words lose case and surrounding punctuation; numbers, units and names become typed
placeholders.  Every text is read in two ways.  Word by word: the words themselves, then with
numbers and units replaced.  By phrases: a name of several words is one placeholder, and so is
a number with its unit, so that replacements of other lengths do not shift what follows.
Windows of all readings are hashed and joined in Spark with the benchmark's windows; matches
add up by (document, item, way of reading, offset).  The values that stood in
the placeholders must then agree, in all that matches or in a run of it: one value of the
item is always replaced by the same value of the document and the other way round, as in a
re-parameterised question.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwatch.llm.lookups import hash_filter, may_hold, small_side
from threadwatch.llm.tables import stored
from threadwatch.llm.words import LOWER_CASE, U64, Words, mix, slices_by_bytes, window_hashes
from threadwatch.llm.workers import begin, kept
from threadwatch.session import ship_package, small_arrow_batches

WIDTH = 8
#: template windows with fewer literal words are too general to say anything; windows of the words themselves need none
LITERALS = 4
#: literal words that are enough if the window is a whole short item and whole sentences of the document
SENTENCE_LITERALS = 2
#: template words that must agree in a row, or the whole item if it is shorter
RUN = 12
#: bytes of text read at once; the arrays made of them take some fifty times that
SLICE_BYTES = 1 << 20
#: benchmark windows up to which that side is broadcast
BROADCAST_WINDOWS = 200_000

# Unit words and signs replaced by the unit placeholder.
UNITS = """
mm cm m km in inch inches ft foot feet yd yard yards mi mile miles
mg g kg t lb lbs oz pound pounds gram grams kilogram kilograms ton tons
ml cl l liter liters litre litres gallon gallons cup cups
ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
hz khz mhz ghz w kw mw kwh v a ohm j kj cal kcal pa kpa bar n kn
meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters millimeter millimeters
mph kph kmh c f degree degrees percent % $ € £ ¥ usd eur gbp dollar dollars cent cents euro euros
""".split()

NUMBER, UNIT, CAPITAL, END, EMPTY, BREAK = 1, 2, 4, 8, 16, 32
FLAGS = U64(63)
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = U64(0x1111111111111111), U64(0x2222222222222222), U64(0x3333333333333333)

_CORE = re.compile(r"[\w%$€£¥](?:.*[\w%$€£¥])?", re.DOTALL)
_NUMBER = re.compile(r"[$€£¥]?\d[\d.,:/]*%?")
#: a number and what is glued to it, as in "30km"
_GLUED = re.compile(r"([$€£¥]?\d[\d.,:/]*)(\D+)")
#: "Anna", "Anna-Maria", "O'Neil" and "McDonald", but not "USA"
_NAME = re.compile(r"[^\W\d_]+(?:[-'’.][^\W\d_]+)*")
#: words for numbers
_NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty "
                    "hundred thousand million billion".split())
_UNITS = set(UNITS)


def quantity(word: bytes) -> tuple[bytes, bytes] | None:
    """The number and the unit of a word that glues them."""
    m = _CORE.search(word.decode("utf-8", "replace"))
    m = m and _GLUED.fullmatch(m.group())
    return (m[1].encode(), m[2].encode()) if m and m[2].lower() in _UNITS else None


def phrase(core, place):
    """What the word at ``place`` (1 and up) of a phrase adds to the phrase's value."""
    return mix(core + place.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(6)


def word_code(word: bytes) -> tuple[int, int]:
    """(core text's hash seed, flags) of a raw word."""
    text = word.decode("utf-8", "replace")
    m = _CORE.search(text)
    tail = text.rstrip("\"')]}»”")
    end = END if tail.endswith((".", "!", "?")) else BREAK if tail.endswith((",", ";", ":")) else 0
    if m is None:
        return 0, EMPTY | end
    core = m.group()
    low = core.lower()
    flags = end
    if _NUMBER.fullmatch(core) or quantity(word) or all(part in _NUMBER_WORDS for part in low.split("-")):
        flags |= NUMBER
    elif low in _UNITS and (len(low) > 1 or not low.isalpha()):
        flags |= UNIT
    elif core[0].isupper() and core != core.upper() and _NAME.fullmatch(core):
        flags |= CAPITAL
    data = low.encode()
    seed = int.from_bytes(data[:8], "little")
    for i in range(8, len(data), 8):
        seed = (seed * 0x9E3779B97F4A7C15 + int.from_bytes(data[i:i + 8], "little") + 1) % 2**64
    return seed, flags


def _cores(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes = [word_code(w) for w in words]
    seeds = mix(np.array([c[0] for c in codes], U64) + U64(0x5851F42D4C957F2D))
    return seeds >> U64(6), np.array([c[1] for c in codes], U64)


def _learn(words: list[bytes]) -> list[int]:
    cores, flags = _cores(words)
    for i, parts in ((i, quantity(w)) for i, w in enumerate(words) if flags[i] & U64(NUMBER)):
        if parts:  # "30km" has the value of the phrase "30 km"
            own = _cores(list(parts))[0]
            cores[i] = own[0] + phrase(own[1:], np.ones(1, np.int64))[0] & U64(2**58 - 1)
    return (cores << U64(6) | flags).tolist()


#: "in" is a unit only after a number
_IN = U64(_learn([b"in"])[0] >> 6)
#: codes of words seen that are not plain, by the words' 64-bit hashes
_SEEN: dict[int, int] = kept({})
#: words that a worker remembers
REMEMBERED = 200_000

# What a byte may be in a plain word: ASCII and the letters of U+00C0 to U+00FF (bytes C3 80 to C3 BF).
_ODD, _LOWER, _SIGN = 1, 2, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x41:0x5B] = 0
_KIND[0x61:0x7B] = _LOWER
_KIND[[0x24, 0x25]] = _SIGN
_KIND[0xC3] = 0
#: ASCII marks, which may stand around a core
_MARK = np.ones(256, bool)
_MARK[0x80:] = False
_MARK[[0x24, 0x25, 0x5F, *range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_CLOSING = np.isin(np.arange(256), list(b"\"')]}"))
_STOP = np.zeros(256, np.uint8)
_STOP[list(b".!?")] = END
_STOP[list(b",;:")] = BREAK
#: marks on either side of a plain word's core, at most
MARKS = 8
#: lowest ``n`` bytes of eight
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: seeds of words that are numbers or units
_SPECIAL = np.array(sorted({word_code(w.encode())[0] for w in _UNITS | _NUMBER_WORDS}), U64)


def _plain_codes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words, places of those whose code is not found here).

    A plain word is letters (and signs) with marks around them, no number and no unit.  What
    ``word_code`` and ``_cores`` say of it is read off the bytes, for all words at once.
    """
    buf = np.concatenate([words.buf, np.zeros(8, np.uint8)])
    start, end = words.start.copy(), words.end.copy()
    for at, step, bound in ((start, 1, end), (end, -1, start)):
        look = np.arange(len(at))
        for _ in range(MARKS):
            look = look[(start[look] < end[look]) & _MARK[buf[at[look] - (step < 0)]]]
            at[look] += step
    odd = (start >= end) | _MARK[buf[start]] | _MARK[buf[end - 1]]
    start[odd], end[odd] = words.start[odd], words.end[odd]

    kind, lead = _KIND[buf], np.flatnonzero(buf == 0xC3) + 1
    follow = buf[lead]
    kind[lead] = np.where((follow == 0x97) | (follow == 0xB7), _ODD, np.where(follow >= 0x9F, _LOWER, 0))
    held = np.bitwise_or.reduceat(kind, np.column_stack([start, end]).ravel())[::2]
    first = buf[start]
    upper = ((first >= 0x41) & (first <= 0x5A)) | ((first == 0xC3) & (buf[start + 1] < 0x9F))
    flags = np.where(upper & (held == _LOWER), CAPITAL, 0).astype(np.uint8)

    marked = np.flatnonzero(end < words.end)
    last = words.end[marked] - 1
    look = np.arange(len(marked))
    for _ in range(MARKS):
        look = look[_CLOSING[buf[last[look]]]]
        last[look] -= 1
    flags[marked] |= _STOP[buf[last]]

    buf = LOWER_CASE[buf]
    buf[lead] += np.where((follow < 0x9F), 0x20, 0).astype(np.uint8)
    eight = np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))
    size = end - start
    seed = eight[start] & _BYTES[np.minimum(size, 8)]
    more = np.flatnonzero((size > 8) & (held & _ODD == 0))
    done = 8
    while len(more):
        part = eight[start[more] + done] & _BYTES[np.minimum(size[more] - done, 8)]
        seed[more] = seed[more] * U64(0x9E3779B97F4A7C15) + part + U64(1)
        done += 8
        more = more[size[more] > done]
    odd |= (held & _ODD > 0) | np.isin(seed, _SPECIAL)
    code = mix(seed + U64(0x5851F42D4C957F2D)) & ~FLAGS | flags
    return code, np.flatnonzero(odd)


def _codes(words: Words) -> np.ndarray:
    """Codes of all words of a batch; each distinct word that is not plain is looked up once."""
    if not len(words):
        return np.zeros(0, U64)
    code, odd = _plain_codes(words)
    own, at, back = np.unique(words.hashes()[odd], return_index=True, return_inverse=True)
    if len(_SEEN) > REMEMBERED:
        _SEEN.clear()
    keys = own.tolist()
    new = [i for i, k in enumerate(keys) if k not in _SEEN]
    if new:
        _SEEN.update(zip((keys[i] for i in new), _learn([words.text(odd[at[i]]) for i in new])))
    code[odd] = np.array([_SEEN[k] for k in keys], U64)[back]
    return code


class Reading:
    """One way of reading a batch: ``doc`` and raw ``word`` position of its words or phrases, whether they open a
    sentence, and ``views``: (number, template words, which of them are slots, the slots' values)."""

    def __init__(self, n_docs: int, doc, word, stops, views):
        self.doc, self.word, self.stops, self.views = doc, word, stops, views
        self.counts = np.bincount(doc, minlength=n_docs)

    def windows(self, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(view, start positions, hashes) of the windows that say enough, each in the first view that reads it so."""
        inside = np.flatnonzero(self.doc[:max(0, len(self.doc) - width + 1)] == self.doc[width - 1:])
        whole, last = None, None
        for view, values, slots, _ in self.views:
            hashes = window_hashes(values, width)[inside] + U64(width + 16 * (view > 1))
            if slots is None:
                literal = np.full(len(inside), width)
                good = np.full(len(inside), width >= LITERALS)
            else:
                total = np.concatenate([[0], np.cumsum(~slots)])
                literal = total[inside + width] - total[inside]
                good = literal >= LITERALS
            if width < WIDTH:
                if whole is None:
                    after = np.append(self.stops, True)[inside + width]
                    whole = self.stops[inside] & after
                    alone = (self.counts[self.doc[inside]] == width) if width == 1 else np.zeros(len(inside), bool)
                good |= whole & (literal >= SENTENCE_LITERALS)
                if slots is None:
                    good |= alone
            if last is not None:  # each view replaces more than the one before
                good &= hashes != last
            last = hashes
            yield view, inside[good], hashes[good]


class Templates:
    """Both readings of a batch, word by word and by phrases."""

    def __init__(self, texts: pa.Array):
        split = Words(texts)
        code, doc = _codes(split), split.doc
        flags = (code & FLAGS).astype(np.uint8)
        word = np.arange(len(code)) - split.first[doc]
        stops = np.zeros(len(code), bool)  # the word before ends a sentence, or there is none
        stops[1:] = (flags[:-1] & END > 0) | (doc[1:] != doc[:-1])
        stops[:1] = True
        # a sentence end on a dropped mark counts for the next word, too
        keep = flags & EMPTY == 0
        doc, word, flags, stops, core = doc[keep], word[keep], flags[keep], stops[keep], code[keep] >> U64(6)
        stops[1:] |= doc[1:] != doc[:-1]
        number, unit, capital = flags & NUMBER > 0, flags & UNIT > 0, flags & CAPITAL > 0
        unit[1:] &= (core[1:] != _IN) | (number[:-1] & ~stops[1:])
        unit[:1] &= core[:1] != _IN
        raw = mix(core)
        plain = np.where(number, NUMBER_SLOT, np.where(unit, UNIT_SLOT, raw))
        words = Reading(len(texts), doc, word, stops, [(0, raw, None, core), (1, plain, number | unit, core)])

        joined = np.zeros(len(core), bool)  # the word goes on with the name or quantity before it
        joined[1:] = ((capital[1:] & capital[:-1]) | (unit[1:] & number[:-1])) & ~stops[1:] & (flags[:-1] & BREAK == 0)
        first = np.flatnonzero(~joined)
        more = np.flatnonzero(joined)
        of = np.cumsum(~joined)[more] - 1
        long = np.zeros(len(first), bool)
        long[of] = True
        opens, capital, literal = stops[first], capital[first], raw[first]
        opener = opens & capital & long  # a literal word and a name, or a name as a whole
        values = []
        for begin in (first + opener, first):
            value, place = core[begin], more - begin[of]
            np.add.at(value, of[place > 0], phrase(core[more[place > 0]], place[place > 0]))
            values.append(value & U64(2**58 - 1))
        slot = number[first] | unit[first]
        plain = plain[first]
        name = capital & (~opens | long)  # a sentence's first word may be a name or not
        named = np.where(opener, mix(literal ^ NAME_SLOT), np.where(name, NAME_SLOT, plain))
        phrases = [(2, named, slot | name, values[0]), (3, np.where(capital, NAME_SLOT, plain), slot | capital, values[1])]
        self.readings = [words, Reading(len(texts), doc[first], word[first], opens, phrases)]


#: ``held`` has a bit for each word that is a slot, ``words`` the words' raw positions
WINDOWS = "row long, id long, n_words int, width int, view int, pos int, hash long, held int, words array<int>, slots array<long>"


def _windows(widths: list[int], wanted=None, short: bool = False):
    """Rows of template windows: those that ``wanted`` may hold, or all; ``short`` items are one window each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("template words")
        for whole in batches:
            for batch in slices_by_bytes(whole, "text", SLICE_BYTES):
                for t in Templates(batch.column("text")).readings:
                    for width in widths:
                        for view, at, hashes in t.windows(width):
                            keep = np.ones(len(at), bool)
                            if wanted is not None:
                                keep = may_hold(wanted.value, hashes)
                            if short:
                                n = t.counts[t.doc[at]]
                                keep &= (n == width) if width < WIDTH else (n >= width)
                            if keep.any():
                                yield _rows(batch, t, width, view, at[keep], hashes[keep])

    return run


def _rows(batch: pa.RecordBatch, t: Reading, width: int, view: int, at: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    doc = t.doc[at]
    span = at[:, None] + np.arange(width)
    _, _, slots, core = next(v for v in t.views if v[0] == view)
    held = np.zeros(span.shape, bool) if slots is None else slots[span]
    ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
    first = np.concatenate([[0], np.cumsum(t.counts)])
    row = pa.array(doc)
    places = np.arange(0, len(at) * width + 1, width)
    return pa.RecordBatch.from_arrays([
        batch.column("row").take(row), batch.column("id").take(row), pa.array(t.counts[doc], pa.int32()),
        pa.array(np.full(len(at), width), pa.int32()), pa.array(np.full(len(at), view), pa.int32()),
        pa.array(at - first[doc], pa.int32()), pa.array(hashes.view(np.int64)),
        pa.array(held @ (1 << np.arange(width)), pa.int32()),
        pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(t.word[span].ravel(), pa.int32())),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(core[span[held]].view(np.int64)))],
        names=["row", "id", "n_words", "width", "view", "pos", "hash", "held", "words", "slots"])


def one_to_one(pairs: set[tuple[int, int]]) -> bool:
    return len(pairs) == len({i for i, _ in pairs}) == len({d for _, d in pairs})


def longest_run(at: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """The longest run of consecutive positions (``at`` is sorted) whose pairs of values agree one to one."""
    best = start = length = 0
    forth: dict[int, int] = {}
    back: dict[int, int] = {}
    count: Counter = Counter()
    for end, q in enumerate(at):
        if end and q != at[end - 1] + 1:
            start = end
            forth, back, count = {}, {}, Counter()
        if q in pairs:
            i, d = pairs[q]
            while forth.get(i, d) != d or back.get(d, i) != i:
                gone = pairs.get(at[start])
                start += 1
                if gone:
                    count[gone] -= 1
                    if not count[gone]:
                        del forth[gone[0]], back[gone[1]]
            forth[i], back[d] = d, i
            count[i, d] += 1
        if end + 1 - start > length:
            best, length = start, end + 1 - start
    return at[best:best + length]


def agreed(hits: list[dict], need: int) -> tuple[int, int, int, int] | None:
    """(matched, first word, values, changed) of what agrees on one offset, if it is ``need`` words or more.

    That is all that the windows of a view and those before it match, or else its longest
    run without a contradiction; the view that matches most counts, then the one that replaces
    the fewest values.
    """
    best = None
    for view in sorted({h["view"] for h in hits}, key=(2, 3, 1, 0).index):
        word: dict[int, int] = {}
        pairs: dict[int, tuple[int, int]] = {}
        for h in hits:
            if h["view"] > view:
                continue
            values = zip(h["item_slots"], h["slots"])
            for k, w in enumerate(h["words"]):
                word[h["q"] + k] = w
                if h["held"] >> k & 1:
                    pairs[h["q"] + k] = next(values)
        part = sorted(word)
        if not one_to_one(set(pairs.values())):
            part = longest_run(part, pairs)
        own = {pairs[q] for q in part if q in pairs}
        changed = sum(i != d for i, d in own)
        if len(part) >= need and (best is None or (len(part), -changed) > (best[0], -best[3])):
            best = len(part), word[part[0]], len(own), changed
    return best


FOUND = "doc_id long, item_id long, item_words int, diagonal int, matched int, first_word int, values int, changed int"


def _judge(run: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                out = []
                for r in whole.slice(a, 64).to_pylist():
                    best = agreed(r["hits"], min(run, r["item_words"]))
                    if best:
                        out.append((r["doc_id"], r["item_id"], r["item_words"], r["diagonal"], *best))
                if out:
                    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                     names=[c.split()[0] for c in FOUND.split(", ")])

    return judge


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row per (document, benchmark item) where the document holds the item's text or template.

    A pair counts if ``run`` template words (or phrases), or all of a shorter item, match on one
    offset and the placeholders' values agree one to one, in all that matches or in ``run`` of
    them in a row; verbatim copies of ``LITERALS`` words or more need no literal words.  An item
    shorter than a window whose template has fewer literal words, or that has fewer words (marks
    are no words), must be whole sentences of the document with ``SENTENCE_LITERALS`` literal
    words, and an item of one word must be all of the document: anywhere else such an item says
    nothing.  Null and empty texts match nothing.  Returns doc_id, item_id, item_words (words, or
    phrases where these match more), matched (those that agree), coverage (their share of the
    item), first_word (raw word position in the document), slots (distinct item values), changed
    (of those, how many the document replaces) and kind (``copy`` or ``re-parameterised``).  Each row is judged by
    itself; of rows that share an id, or have none, the best match is returned under that id.
    Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    widths = list(range(1, WIDTH + 1))
    items = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).cast("long").alias("id"),
                             F.col(item_text_col).cast("string").alias("text")) \
        .mapInArrow(_windows(widths, short=True), WINDOWS)
    items = items.select(F.col("row").alias("item_row"), F.col("id").alias("item_id"), F.col("n_words").alias("item_words"),
                         "width", "hash", "held", F.col("view").alias("item_view"), F.col("pos").alias("q"),
                         F.col("slots").alias("item_slots"))
    wanted = hash_filter(items, "hash")
    lengths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most WIDTH rows
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).cast("string").alias("text")).mapInArrow(_windows(lengths, wanted), WINDOWS)
    hits = found.join(small_side(items, BROADCAST_WINDOWS), ["width", "hash", "held"]) \
        .select(F.col("row").alias("doc_row"), F.col("id").alias("doc_id"), "item_row", "item_id", "item_words",
                (F.col("pos") - F.col("q")).alias("diagonal"), F.greatest("view", "item_view").alias("view"),
                (F.col("view") > 1).alias("phrases"), "q", "held", "words", "item_slots", "slots")
    with small_arrow_batches(spark):
        hits = stored(hits)
    by = ["doc_row", "doc_id", "item_row", "item_id", "item_words", "phrases", "diagonal"]
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["q"], h["q"] + F.size(h["words"]) - 1))))
    spans = hits.groupBy(*by).agg(F.collect_list(F.struct("view", "q", "held", "words", "item_slots", "slots")).alias("hits")) \
        .filter(F.size(covered) >= F.least(F.lit(run), "item_words"))
    good = spans.select("doc_id", "item_id", "item_words", "diagonal", "hits").mapInArrow(_judge(run), FOUND)
    best = good.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(
        "item_words", "matched", "first_word", "values", "changed"), F.struct(
        "matched", -F.col("changed"), -F.col("diagonal"), -F.col("first_word"))).alias("b"))
    return best.select(
        "doc_id", "item_id", F.col("b.item_words").cast("long").alias("item_words"),
        F.col("b.matched").cast("long").alias("matched"), (F.col("b.matched") / F.col("b.item_words")).alias("coverage"),
        F.col("b.first_word").cast("long").alias("first_word"), F.col("b.values").cast("long").alias("slots"),
        F.col("b.changed").cast("long").alias("changed"),
        F.when(F.col("b.changed") > 0, "re-parameterised").otherwise("copy").alias("kind"))


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` against every item of ``benchmark``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
