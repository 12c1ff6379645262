"""Null, empty, white space, short, very long, repeated rows, ties, null ids and null sources."""

ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one two", "b"), (5, "One TWO", "b"), (5, "One TWO", "b"), (6, "lonely wörd 字 😀", None),
    (7, "long text " * 30_000, "a"), (8, "x" * 50_000, "c"), (None, "no id here at all, but some words", "a"), (None, None, None), (None, "no id here at all, but some words", "a"),
    (20, "a\x0bb\x0cc\x1fd e", "b"), (21, "ÀÉ İ ẞ", "é"),
]
