"""Small tricky texts for the tests."""

import random


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def tricky_texts():
    """Nulls, empties, repeats, near copies, long texts, odd white space and scripts."""
    base = words(120, 1)
    near = base.copy()
    near[60] = "changed"
    shared = words(55, 2)
    return [
        (0, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (3, None), (4, ""), (5, "  \n\t "), (6, "one"),
        (7, "one two"), (8, "ONE Two"), (9, "one two three"), (10, " ".join(words(30, 3) + shared + words(30, 4))),
        (11, " ".join(words(10, 5) + shared + words(50, 6))), (12, "x " * 70), (13, "\n".join(words(200, 7))),
        (14, " ".join(words(9000, 8, 50_000))), (15, "ümläut ß – ÀÉ   naïve fin 你好 世界 " * 8),
        (16, " ".join(shared)), (None, " ".join(base)), (None, None), (17, "no <|endoftext|> here <|startoftext|>x"),
        (18, "a" * 5000), (19, "don't  can't\r\nwon't\x0bend\x0c."), (2, " ".join(base)), (20, "\x01 odd\x1cmark\x85 here"),
    ]
