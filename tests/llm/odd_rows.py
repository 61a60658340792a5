"""Rows that try every operator."""

import random

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, key string, words int, "
           "label array<int>, topic double, tokens string, b string, uid string, n int, h string")


def prose(seed, n):
    r = random.Random(seed)
    parts = ["the", "er", "on", "ing", "ou", "be", "re", "st"]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) + r.choice(["", "", ",", "."]) for _ in range(n))


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and
    columns whose names clash with the operators' own."""
    base = prose(1, 120)
    texts = [
        (1, base), (2, None), (3, ""), (4, "  \n\t "), (5, "One"), (6, "Two words"), (7, prose(2, 60_000)),
        (8, base), (8, base), (9, base.replace("the", "THE", 1)), (None, prose(3, 80)), (10, prose(4, 200)),
        (11, prose(5, 70) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(6, 9)),
        (12, prose(7, 60) + ' token = "%s" ' % ("0123456789abcdef" * 3)[5:45] + prose(8, 30)),
        (13, "é ß 漢字   x\r\ny  double  " + prose(9, 90)), (14, prose(10, 90) + "\n" + prose(10, 90)),
        (2**62, prose(11, 90)), (-5, prose(12, 90)), (15, "a\0b <|endoftext|> 0 00"),
    ]
    return [(i, t, None if i == 10 else "en", None if i == 11 else f"s{(i or 0) % 3}", None if t is None else len(t),
             "k", 1, [1], 0.5, "t", "b", "u", 7, "h") for i, t in texts]
