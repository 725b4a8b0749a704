"""Rows with nulls, empty and very long texts, repeats."""

ODD = [
    (1, "a b c d e f", "s1"),
    (1, "a b c d e f", "s1"),
    (None, "no id at all here", None),
    (2, None, "s2"),
    (3, "", None),
    (4, "  \t\n ", "s1"),
    (5, "wörter und \U0001f600 mehr " * 20_000, "s2"),
    (6, "a b c d e f", "s3"),
    (7, "x", "s3"),
]
