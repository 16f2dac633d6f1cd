"""Texts at the edges, and how rows are compared."""

LONG = "".join(f"word{i % 977} " for i in range(30000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "... !!"), (5, "a"), (5, "a"), (6, "abc " * 40000), (7, LONG), (8, LONG.upper()),
    (9, None), (10, "Straße ÀÉ ñandú 日本語 🙂 don't we'll " * 9), (11, "straße ÀÉ ñandú 日本語 🙂 DON'T we'll " * 9),
    (None, "a"), (None, None), (12, "one two three four"), (13, "ONE two three four"), (14, "one two three four five"),
    (15, " \x85\x1c x\r\n  y'S 'tis 12³ Ⅷ" * 4), (-7, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today"),
    (16, "so the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today ok"), (17, "x" * 5000), (18, "Y" * 5001),
]


def rows_of(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
