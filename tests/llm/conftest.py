from __future__ import annotations

import pytest

TEXT = "The quick brown fox jumps over the lazy dog and runs to the river in the morning of the first day. "
ODD = [
    (1, TEXT * 3, "en", "a", 10, 7),
    (2, TEXT * 3, "en", "a", 10, 7),
    (2, TEXT * 3, "en", "a", 10, 7),  # a repeated row
    (3, None, "en", "b", None, None),
    (4, "", None, None, 0, 1),
    (5, " \t\n ", "xx", "b", 4, 2),
    (6, "a b c", "en", "é", 5, 3),
    (7, "a b c", "de", "é", 5, 3),
    (None, "no id here at all, sir", "fr", "c", 22, None),
    (8, "wörd " * 20_000, "de", "a", 120_000, 4),  # a very long text
    (9, "x" * 50_000, "es", None, 50_000, 5),  # one very long word
    (10, "line one\nline one\n\n### || $$\nline two", "fr", "c", 30, 6),
    (-11, "  no break \U0001f600 emoji \x00 zero", "en", "b", 12, 8),
    (12, TEXT * 3 + "one more word here", "en", "b", 12, 8),
]
#: A column of a name that some operators add or use themselves.
CLASH = "score"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH} int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
