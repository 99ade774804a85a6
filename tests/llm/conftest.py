from __future__ import annotations

import pytest

#: Texts that bend rules: null, empty, blanks, ties, copies, a long one, marks and special strings.
ODD = [None, "", "   \t\n", "a", "A  b\tc", "a b c", "A  b\tc", "x " * 3000, "naïve é ́ é İ ß Σς", "<|endoftext|> it's 'S 12 34 z\x1cq", "\U0001f600 ok\r\nline", "word" * 400]


@pytest.fixture
def make(spark):
    """documents of (doc_id, text[, source]) with columns that clash with the operators' own names."""

    def build(texts, ids=None, source=None):
        rows = [(i if ids is None else ids[i], t, source[i] if source else "s", 7, "z", 1.5, True) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, start long, cell0 string, size double, kept boolean")

    return build


@pytest.fixture
def odd():
    return list(ODD)
