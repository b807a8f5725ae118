"""Operators on documents against brute force over small tricky tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadwatch.llm import op1_decontamination as op1
from threadwatch.llm import op2_substring as op2
from threadwatch.llm import op3_quality as op3
from threadwatch.llm import op4_licenses as op4
from threadwatch.llm import op5_token_counts as op5
from threadwatch.llm import op6_near_dup as op6
from threadwatch.llm import op9_packing as op9

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def tricky_rows():
    from tricky import tricky_texts
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in tricky_texts()]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- substring dedup -------------------------------------------------------------------

def substring_brute_force(rows, k=20):
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, rows[n][1] or ""))
    seen, out = set(), []
    for n in order:
        w = SPACES.findall(rows[n][1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            if key in seen:
                gone[i:i + k] = [True] * k
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((rows[n][0], len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("chunk_bytes,bucket_windows", [(1 << 21, 1 << 20), (700, 40)])
def test_substring_dedup(docs, chunk_bytes, bucket_windows):
    got = op2.remove_repeats(docs, chunk_bytes=chunk_bytes, bucket_windows=bucket_windows)
    digest = rows_of(got.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256)))
    assert Counter(digest) == substring_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    for r in got.collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_substring_dedup_keeps_layout(docs):
    got = {(r.doc_id, r.text): r for r in op2.remove_repeats(docs.withColumn("text2", F.col("text")), carry=("text",),
                                                            text_col="text2", keep_layout=True).collect()}
    assert got[(13, next(t for i, t in got if i == 13))].kept_text.count("\n") == 199
    assert got[(3, None)].kept_text is None
    for (_, text), r in got.items():
        if not r.n_removed:
            assert r.kept_text == text


def test_substring_dedup_of_nothing_and_clashes(nothing, clashing, docs):
    assert op2.remove_repeats(nothing).count() == 0
    assert op2.remove_repeats(clashing, carry=("score", "_text", "_id")).count() == docs.count()


# --- near duplicates --------------------------------------------------------------------

def near_brute_force(rows, k, percent):
    sets = []
    for _, t in rows:
        w = SPACES.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in product(range(len(rows)), repeat=2):
        if a < b and sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    out = []
    for n, (i, _) in enumerate(rows):
        c = least.get(root(n)) if sets[n] else i
        out.append((i, len(sets[n]), c, True if c is None else i == c))
    return Counter(out)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    got = op6.near_duplicates(docs, shingle=k, percent=percent)
    assert Counter(rows_of(got)) == near_brute_force([(r.doc_id, r.text) for r in docs.collect()], k, percent)


def test_near_duplicates_in_chains_and_crowds(spark):
    """Chains of edits whose ends are far apart, and a crowd of near copies: components as by brute force."""
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(4):
        text = [f"v{rng.randrange(900)}" for _ in range(90)]
        for _ in range(25):
            rows.append((n, " ".join(text)))
            n += 1
            text = text.copy()
            for _ in range(rng.choice([1, 1, 2, 3])):
                text[rng.randrange(90)] = f"v{rng.randrange(900)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(rows_of(op6.near_duplicates(df, shingle=3, percent=85))) == near_brute_force(rows, 3, 85)


def test_blocks_find_what_pivots_leave_apart(spark, monkeypatch):
    """Families and their links do not depend on the block sizes."""
    sig = np.arange(16, dtype=np.int64).reshape(2, 8) * 0x0123456789ABCDE
    keys = [bytes([i] * 16) for i in range(9)]
    shared = spark.createDataFrame([(1, k, k, 9) for k in keys], "band long, key binary, root binary, size long")
    sigs = spark.createDataFrame([(k, sig[i % 2].tolist()) for i, k in enumerate(keys)], "key binary, sig array<long>")
    sets = [sorted({*range(10 * (i % 2), 10 * (i % 2) + 20)} - {i // 2}) for i in range(9)]
    members = spark.createDataFrame([(b"r", k, k, len(x), x) for k, x in zip(keys, sets)],
                                    "region binary, root binary, key binary, n int, shingles array<long>")
    for block, shingles in ((512, 1 << 18), (2, 40)):
        monkeypatch.setattr(op6, "BLOCK", block)
        monkeypatch.setattr(op6, "BLOCK_SHINGLES", shingles)
        for edges in (op6.family_edges(shared, sigs, 0.99, 128), op6.links_within(members, 85)):
            of = {k: k for k in keys}
            for r in edges.collect():
                a, b = of[bytes(r.a)], of[bytes(r.b)]
                of = {k: a if v == b else v for k, v in of.items()}
            assert {k[0] % 2 for k in keys if of[k] == of[keys[0]]} == {0}
            assert len(set(of.values())) == 2


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(3)
    out = []
    for s in (0.0, 0.5, 0.9):
        a = rng.integers(0, 16, (400, 128))
        b = np.where(rng.random((400, 128)) < s, a, rng.integers(0, 16, (400, 128)))
        packed = [np.bitwise_or.reduce(x.reshape(400, 8, 16).astype(np.uint64) << (np.arange(16, dtype=np.uint64) * np.uint64(4)),
                                       axis=2).view(np.int64).tolist() for x in (a, b)]
        df = spark.createDataFrame(list(zip(*packed)), "a array<long>, b array<long>")
        out.append(df.select(F.avg(op6.estimate("a", "b", 128))).first()[0])
    assert np.allclose(out, [0.0, 0.5, 0.9], atol=0.02)


def test_near_duplicates_of_nothing_and_clashes(nothing, clashing, docs):
    assert op6.near_duplicates(nothing).count() == 0
    assert op6.near_duplicates(clashing).count() == docs.count()


# --- token counts and packing ----------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizers_of():
    import public_tokenizers
    from tokenizers import Tokenizer
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


ODD = ["", " ", "a", " a", "a ", "a  b", "a   b\n\nc", "\na", "a\n b", "tab\tx", "x y", "It's we'll THEY'RE", "Straße Ünïcode",
       "İstanbul ΣΑΣ", "é ñ", "1234 5,6", "###%%%&&& !!", "word.### more***", "<|endoftext|>", "a<|endoftext|> b",
       "x\x1cy \x85 z", "日本語 テスト", "🙂 🙂🙂", "foo_bar __x__", "a" * 300, "\x01 \x01a", "ÿÀ× ÷", "l’été d’or"]


def test_token_counts(spark, docs, tokenizers_of):
    rng = random.Random(1)
    mixed = [(n, "".join(rng.choice(ODD) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 9)))) for n in range(600)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(mixed, "doc_id long, text string"))
    t = tokenizers_of["byte_bpe_50k.json"]
    got = Counter(rows_of(op5.token_counts(df)))
    exp = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows_of(df))
    assert got == exp


def test_packing(spark, docs, tokenizers_of):
    rng = random.Random(2)
    mixed = [(n + 100, "".join(rng.choice(ODD) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 9)))) for n in range(600)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(mixed, "doc_id long, text string"))
    t = tokenizers_of["word_bpe_49k.json"]
    exp = Counter()
    total = 0
    for i, x in rows_of(df):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        for piece, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            exp[(i, piece, s, len(part), zlib.crc32(part.tobytes()))] += 1
    got = op9.pack_documents(df).toPandas()
    keys = [(None if i != i else int(i), *r) for i, *r in
            got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert Counter(keys) == exp
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert ((ends - got.length) == got.offset).all() and (ends <= 2048).all()
    assert got.sequence_id.nunique() <= -(-total // 2048) + 1


def fewest_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_a_best_packing(monkeypatch):
    rng = random.Random(9)
    for _ in range(150):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(3, 10))]
        rest = {}
        with monkeypatch.context() as m:
            m.setattr(op9, "best_fit", lambda counts, _: rest.update(counts) or [])
            fixed = sum(n for _, n in op9.plan_bins(Counter(items), capacity))
        left = [k for k, n in rest.items() for _ in range(n)]
        assert fixed + (fewest_bins(left, capacity) if left else 0) == fewest_bins(items, capacity)
        bins = op9.plan_bins(Counter(items), capacity)
        held = Counter()
        for contents, n in bins:
            assert sum(k * m for k, m in contents) <= capacity
            for k, m in contents:
                held[k] += m * n
        assert held == Counter(items)


def test_tokens_of_nothing_and_clashes(nothing, clashing, docs):
    assert op5.token_counts(nothing).count() == 0 and op9.pack_documents(nothing).count() == 0
    assert op5.token_counts(clashing, carry=("doc_id", "_text", "_row", "n_tokens")).count() == docs.count()
    assert op9.pack_documents(clashing).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


# --- licenses --------------------------------------------------------------------------

def license_brute_force(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for label, phrase in op4.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_phrases(spark, docs):
    rng = random.Random(3)
    pool = "under the mit license apache version 2 cc by nc MIT, License. x 2.0 the".split()
    texts = [(n + 100, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))) for n in range(300)]
    texts += [(900, "Under the MIT License under the mit license"), (901, "CC BY-NC 4.0"), (902, "Apache License, Version 2.0")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    got = Counter(rows_of(op4.scan_licenses(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")))
    assert got == Counter((i, *license_brute_force(t)) for i, t in rows_of(df))


def test_license_notices_survive_small_changes(spark):
    notice = dict(op4.NOTICES)["bsd"].split()
    rows = [(0, " ".join(["a"] * 9 + notice + ["b"])), (1, " ".join(notice[:8] + ["new"] + notice[8:])),
            (2, " ".join(notice[:6])), (3, "licensed under the GNU General Public License, version 3."),
            (4, "licensed under the GNU General Public License, version 4."), (5, None)]
    got = {r.doc_id: r for r in op4.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == got[1].labels == "bsd" and got[0].score == 1.0 and 0.6 <= got[1].score < 1
    assert (got[0].spans[0].start, got[0].spans[0].end) == (9, 9 + len(notice))
    assert got[2].labels == "" and got[2].score == 0 and got[3].labels == "gpl-3" and got[4].labels == ""
    assert (got[5].n_words, got[5].labels, got[5].spans) == (0, "", [])


def test_licenses_of_nothing_and_clashes(nothing, clashing, docs):
    assert op4.scan_licenses(nothing).count() == 0
    assert op4.scan_licenses(clashing, carry=("doc_id", "_text", "hash")).count() == docs.count()


# --- decontamination -------------------------------------------------------------------

ITEM = ("Anna Rossi drives 120 km from Milan in 3 hours and then walks 5 km more before dinner. "
        "How many km does Anna Rossi cover if she drives 120 km again?")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, "short words only here now"), (3, " ".join(f"b{n}" for n in range(40))), (4, None), (5, ""),
            (6, "two words")]
    return spark.createDataFrame(rows, "item_id long, text string")


def changed(text, **new):
    for a, b in new.items():
        text = text.replace(a, b)
    return text


def test_decontamination(spark, benchmark):
    filler = " ".join(f"z{n}" for n in range(30))
    swap = ITEM.replace("120", "250").replace("Rossi", "Bianchi").replace(" 3 ", " 7 ")
    uneven = ITEM.replace("120", "250", 1).replace("120", "99")
    rows = [(0, f"{filler} {ITEM} {filler}"), (1, f"{filler}. {swap} {filler}"), (2, ITEM.lower()), (3, filler),
            (4, uneven), (5, None), (6, ""), (7, "x short words only here now y"), (8, "short words only there now"),
            (9, f"{filler} " + " ".join(f"b{n}" for n in range(10, 25)) + f" {filler}"),
            (10, " ".join(f"b{n}" for n in range(8))), (11, "two words"), (None, ITEM), (12, f"**{ITEM.replace(' ', '  ')}**")]
    got = {(r.doc_id, r.item_id): r for r in op1.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert {(0, 1), (1, 1), (2, 1), (7, 2), (9, 3), (11, 6), (None, 1), (12, 1)} <= set(got)
    assert not {d for d, _ in got} & {3, 5, 6, 8, 10}
    assert got[(0, 1)].kind == "copy" and got[(0, 1)].coverage == 1.0
    assert got[(1, 1)].kind == "re-parameterised" and got[(1, 1)].changed == 3
    if (4, 1) in got:  # the part in which one value stands for one value may still count, the whole may not
        assert got[(4, 1)].coverage < 1


def contaminated_pairs(spark, docs, items):
    """{(doc_id, item_id): row} of texts numbered from 0, items from 1."""
    rows = op1.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
                            spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_decontamination_finds_copies_with_few_literal_words(spark):
    items = ["1, 1, 2, 3, 5, 8, 13, 21, what is the next number", "Calculate 3 + 4 * 5 - 6 / 2 + 8.",
             "Mr Rossi, Anna Bianchi, Carlo Verdi, Dino Neri, Elena Gallo, Franco Conti, Gina Bruno", "12 birds in 4 nests in 3 trees"]
    docs = [f"some words before {item} some words after" for item in items]
    got = contaminated_pairs(spark, [*docs, "Calculate 3 + 4 * 5 - 6 / 2 + 9.", "see 15 birds in 6 nests in 2 trees there"], items)
    assert set(got) == {(0, 1), (1, 2), (2, 3), (3, 4), (5, 4)}
    assert all(got[(n, n + 1)].kind == "copy" and got[(n, n + 1)].coverage == 1 for n in range(4))
    assert got[(5, 4)].kind == "re-parameterised" and got[(5, 4)].changed == 3


def test_decontamination_finds_replaced_names_that_open_sentences(spark):
    items = ["Alice has 12 apples. Bob has 30 pears. Alice gives Bob 4 apples. How many apples does Alice have now?",
             "Alice has 12 apples and gives 4 to Bob."]
    docs = [changed(item, Alice="Carla", Bob="Dieter") for item in items]
    docs += [changed(item, **{"12": "17", "30": "45", "4": "9"}) for item in docs]
    got = contaminated_pairs(spark, [f"the text before ends here. {d} then more" for d in docs], items)
    assert {(0, 1), (1, 2), (2, 1), (3, 2)} == set(got)
    assert {k: (r.coverage, r.changed, r.kind) for k, r in got.items()} == {
        (0, 1): (1, 2, "re-parameterised"), (1, 2): (1, 2, "re-parameterised"),
        (2, 1): (1, 5, "re-parameterised"), (3, 2): (1, 4, "re-parameterised")}


def test_decontamination_judges_values_by_runs_and_rows(spark, benchmark):
    swap = ITEM.replace("Rossi", "Bianchi").replace(" 3 ", " 7 ")
    even = "Each of 5 boys has 5 coins and each of 5 girls has 5 pens"
    rows = [(0, ITEM.replace("120", "250", 1)), (1, f"z {ITEM.replace('120', '250', 1)}"), (7, swap.replace("120", "250")),
            (7, swap.replace("120", "99")), (None, swap.replace("120", "250")), (None, swap.replace("120", "99")),
            (8, "Each of 3 boys has 4 coins and each of 6 girls has 7 pens"), (9, even.replace("5", "6"))]
    items = benchmark.unionByName(spark.createDataFrame([(8, even)], benchmark.schema))
    got = {(r.doc_id, r.item_id): r for r in op1.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (7, 1), (None, 1), (9, 8)}
    assert (got[(0, 1)].matched, got[(0, 1)].first_word, got[(0, 1)].changed) == (28, 0, 1)
    assert got[(1, 1)].first_word == 1 and got[(7, 1)].changed == got[(None, 1)].changed == 3


def test_decontamination_of_short_items(spark):
    items = ["What is 7 x 8?", "Name two primes.", "Paris", "Alice has 3 apples.", "7 8 9"]
    docs = ["Solve this. What is 9 x 6? Then rest.", "What is 7 x 8?", "So what is 9 x 6 then?", "First: name two primes please.",
            "Go on. Name three primes. Stop.", "Paris", "She lives in Paris now.", "Where? Paris. There.", "Bob has 12 apples.",
            "Today Bob has 12 apples and more.", "see 7 8 9 here", "7 8 9", "1 2 3"]
    got = contaminated_pairs(spark, docs, items)
    assert set(got) == {(0, 1), (1, 1), (4, 2), (5, 3), (8, 4), (11, 5)}
    assert got[(0, 1)].kind == got[(4, 2)].kind == got[(8, 4)].kind == "re-parameterised"
    assert got[(1, 1)].kind == got[(5, 3)].kind == got[(11, 5)].kind == "copy"


def test_decontamination_finds_names_and_quantities_of_other_lengths(spark):
    item = "Yesterday Mary Smith ran 30km before Bob met her, and then Mary Smith ran 30km more with Bob."
    docs = ["Yesterday Mary Ann Smith ran 30km before Bob met her, and then Mary Ann Smith ran 30km more with Bob.",
            "Yesterday Mary Smith ran 45 km before Bob met her, and then Mary Smith ran 45 km more with Bob.",
            "Yesterday Anna-Maria O'Neil ran 45km before McDonald met her, and then Anna-Maria O'Neil ran 45 km more with McDonald.",
            "Yesterday Sue ran 8 miles before Kim met her, and then Sue ran 8 miles more with Kim.",
            "Yesterday Sue ran 8 miles before Kim met her, and then Kim ran 9 miles more with Sue.",
            item.lower(), item.replace(",", ""), "Yesterday Mary Smith sat at home before Bob met her there again."]
    got = contaminated_pairs(spark, [f"Some text. {d} The rest." for d in docs], [item])
    assert {d for d, _ in got} == {0, 1, 2, 3, 5, 6}
    assert {d: (r.kind, r.changed) for (d, _), r in got.items()} == {
        0: ("re-parameterised", 1), 1: ("re-parameterised", 1), 2: ("re-parameterised", 3), 3: ("re-parameterised", 3),
        5: ("copy", 0), 6: ("copy", 0)}


@pytest.mark.parametrize("word, flags", [
    ("Anna", op1.CAPITAL), ("Anna-Maria,", op1.CAPITAL | op1.BREAK), ("O'Neil", op1.CAPITAL), ("McDonald.", op1.CAPITAL | op1.END),
    ("USA", 0), ("I", 0), ("Élodie's", op1.CAPITAL), ("iPhone", 0), ("B2b", 0), ("30km", op1.NUMBER), ("$5", op1.NUMBER),
    ("7.5kg;", op1.NUMBER | op1.BREAK), ("twenty-five", op1.NUMBER), ("30x", 0), ("km", op1.UNIT), ("m", 0), ("—", op1.EMPTY),
    ("...", op1.EMPTY | op1.END)])
def test_kinds_of_words(word, flags):
    assert op1.word_code(word.encode())[1] == flags


# A plain twin of the readings: tuples instead of arrays, windows compared with each other instead of hashes joined.

def plain_words(text):
    out, stop = [], True
    for raw, word in enumerate(text.split()):
        flags = op1.word_code(word.encode())[1]
        if not flags & op1.EMPTY:
            parts = op1.quantity(word.encode())
            core = op1._CORE.search(word).group().lower()
            value = tuple(p.decode().lower() for p in parts) if parts else (core,)
            kind = "number" if flags & op1.NUMBER else "unit" if flags & op1.UNIT else "name" if flags & op1.CAPITAL else ""
            if core == "in" and not (out and out[-1][1] == "number" and not stop):
                kind = "" if kind == "unit" else kind
            out.append((value, kind, stop, bool(flags & op1.BREAK), raw))
        stop = bool(flags & op1.END)
    return out


def plain_phrases(words):
    out = []
    for i, (value, kind, stop, _, raw) in enumerate(words):
        before = words[i - 1] if i else None
        if before and not stop and not before[3] and (kind, before[1]) in {("name", "name"), ("unit", "number")}:
            out[-1] = (out[-1][0] + value, *out[-1][1:4], out[-1][4] + 1)
        else:
            out.append((value, kind, stop, raw, 1))
    return out


def plain_views(text):
    """{reading: (stops, [(template words, values of the slots or None)])}."""
    words = plain_words(text)
    phrases = plain_phrases(words)
    raw = [((v, ""), None) for v, *_ in words]
    plain = [((k, "slot"), v) if k in ("number", "unit") else ((v, ""), None) for v, k, *_ in words]
    named, opened = [], []
    for v, k, stop, _, n in phrases:
        slot = ((k, "slot"), v)
        named.append(slot if k in ("number", "unit") or k == "name" and not stop else
                     ((v[0], "and name"), v[1:]) if k == "name" and n > 1 else ((v, ""), None))
        opened.append(slot if k else ((v, ""), None))
    return [([w[2] for w in words], [raw, plain]), ([p[2] for p in phrases], [named, opened])]


def plain_windows(stops, view, literal_free, n_item):
    width = min(op1.WIDTH, n_item)
    for a in range(len(view) - width + 1):
        part = view[a:a + width]
        literal = sum(v is None for _, v in part)
        whole = stops[a] and (a + width == len(view) or stops[a + width])
        if (literal >= op1.LITERALS or literal_free and width >= op1.LITERALS
                or width < op1.WIDTH and whole and literal >= op1.SENTENCE_LITERALS
                or width == 1 == len(view) and literal_free):
            yield a, tuple(w for w, _ in part)


def plainly_contaminated(doc, item):
    for reading, ((d_stops, d_views), (i_stops, i_views)) in enumerate(zip(plain_views(doc), plain_views(item))):
        n = len(i_stops)
        if not n:
            continue
        need, width = min(op1.RUN, n), min(op1.WIDTH, n)
        for k in (1, 2):  # the views up to the k-th
            at = {}
            for j, (d, i) in enumerate(list(zip(d_views, i_views))[:k]):
                literal_free = reading == j == 0
                theirs = list(plain_windows(i_stops, i, literal_free, n))
                for a, key in plain_windows(d_stops, d, literal_free, n):
                    for b, other in theirs:
                        if key == other:
                            for x in range(width):
                                pair = (i[b + x][1], d[a + x][1]) if i[b + x][1] is not None else None
                                old = at.setdefault(a - b, {}).get(b + x)
                                at[a - b][b + x] = pair or old
            for matched in at.values():
                for a in range(n):
                    for b in range(a + need, n + 1):
                        run = [matched.get(q, 0) for q in range(a, b)]
                        if 0 not in run and op1.one_to_one({p for p in run if p}):
                            return True
                if len(matched) >= need and op1.one_to_one({p for p in matched.values() if p}):
                    return True
    return False


def test_decontamination_equals_plain_comparison(spark):
    rng = random.Random(5)
    vocabulary = ("anna Anna Bob O'Neil Mary Smith 3 4 30km 30 km miles in Did the has runs to. of apples, and — buys twenty "
                  "How many left? x y z w").split()

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [text(n) for n in [1, 2, 3, 4, 4, 5, 5, 6, 7, 8, 9, 10, 12, 13, 16, 20, 24, 30, 30, 40]]
    swaps = {"Anna": "Bob", "3": "7", "30km": "45 km", "Mary": "Sue Ann", "30": "9", "Smith": "Jones"}
    docs = []
    for n in range(160):
        item = rng.choice(items).split()
        if n % 4:
            chosen = rng.sample(sorted(swaps), rng.randrange(4))
            item = [swaps[w] if w in chosen else w for w in item]
        if n % 5 == 0 and item:
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        if n % 7 == 0:
            item = item[rng.randrange(len(item)):]
        docs.append(" ".join([text(rng.randrange(9)), " ".join(item), text(rng.randrange(9))]).strip())
    got = set(contaminated_pairs(spark, docs, items))
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items, 1) if plainly_contaminated(doc, item)}
    assert len(want) > 60
    assert got == want


def test_decontamination_of_long_words_and_texts(spark):
    item = "one item whose words stand in the middle of a very long text"
    docs = [f"{'x' * 3_000_000} {item} {'y' * 3_000_000}", " ".join(["so on"] * 300_000) + " " + item, "z" * 3_000_000]
    assert set(contaminated_pairs(spark, docs, [item])) == {(0, 1), (1, 1)}


def test_longest_run_of_agreeing_values():
    assert op1.longest_run([], {}) == []
    assert op1.longest_run([0, 1, 2, 5, 6], {}) == [0, 1, 2]
    assert op1.longest_run([*range(6)], {0: (1, 1), 2: (1, 2), 5: (1, 2)}) == [1, 2, 3, 4, 5]
    assert op1.longest_run([*range(6)], {0: (1, 9), 1: (2, 8), 4: (3, 9)}) == [1, 2, 3, 4, 5]


def test_decontamination_of_nothing_and_clashes(spark, nothing, clashing, benchmark):
    assert op1.contaminated(nothing, benchmark).count() == 0
    assert op1.contaminated(clashing, benchmark.limit(0)).count() == 0
    assert op1.contaminated(clashing, benchmark.withColumn("hash", F.lit(1)).withColumn("id", F.lit(2))).count() == 0


# --- quality ---------------------------------------------------------------------------

def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = op3.Machine(np.zeros((op3.BINS - 1, len(op3.STATISTICS))), np.zeros(len(op3.STATISTICS)), np.ones(len(op3.STATISTICS)))
    m.w0, m.w = 0.3, rng.normal(size=m.size)
    offsets, index = np.array([0, 3, 5]), np.array([1, 5, 9, 2, 5])
    value = rng.normal(size=5)
    got, _ = m.raw(offsets, index, value)
    for row in range(2):
        i, x = index[offsets[row]:offsets[row + 1]], value[offsets[row]:offsets[row + 1]]
        slow = m.w0 + (m.w[i] * x).sum() + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(got[row], slow)


def test_quality_learns_and_never_looks_at_held_out_rows(spark, docs, clashing, nothing):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        w = [f"w{rng.randrange(300)}" for _ in range(40)]
        rows.append((i, " ".join(w) + "." if good else "!! ".join(x.upper() for x in w)))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    machine = op3.fit(df, lab)
    got = {r.doc_id: r for r in op3.score_quality(df, machine).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    turned = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality"))
                            .otherwise(F.col("quality")))
    again = op3.fit(df.repartition(5), turned)  # neither held-out labels nor the order of rows matter
    assert np.allclose(again.w, machine.w) and np.allclose(again.v, machine.v)
    assert op3.score_quality(docs, machine).filter("score is null or isnan(score)").count() == 0
    assert op3.score_quality(clashing, machine, carry=("doc_id", "_text", "label")).count() == docs.count()
    assert op3.score_quality(nothing, machine).count() == 0
    assert op3.fit(nothing, lab) is None
    assert {r.score for r in op3.score_quality(docs, None).collect()} == {0.5}
