"""Rows that the tests of this folder share."""

import pytest

SMALL = "/root/testdata/sf0.001"

#: Nulls in every column, empty and blank texts, a repeated row, a repeated id, a very long text.
ODD = [
    (1, None, None, None), (2, "", "a"), (3, " \t\n ", "a"), (4, "one", None), (5, "one two three", "b"), (5, "one two three", "b"),
    (5, "another text", "b"), (None, "no id at all here", "c"), (None, None, None, None), (9, "wörter für dich " * 3000, "c"),
    (10, "漢字かな交じり文です。" * 5, "d"), (11, "a" * 5000, "d"),
]


@pytest.fixture
def documents(spark):
    """Documents from ``(doc_id, text[, source[, lang]])`` rows, with extra columns named like internal ones."""
    def make(*rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "k", 1) for r in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, `key` string, range_ int"
        )
    return make
