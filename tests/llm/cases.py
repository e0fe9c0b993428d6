"""Rows that every operator has to take."""

#: Null and empty texts, white space alone, one word, repeated rows, ties, a word and a text past one hashing chunk.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (4, "one"), (5, "a b c d e"), (6, "a b c d e"), (7, "ü" * 10), (8, "z" * 300_000), (9, "w1 w2 w3 " * 40_000), (None, "no id"), (None, None),
]
