from __future__ import annotations

import pytest

#: Nulls in any column, empty and very long texts, ties, repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog " * 12, "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (None, "no id here", "en", None),
    (4, "  \n\t ", None, "b"),
    (5, "word%d " % 5 + " ".join(f"w{i}" for i in range(30_000)), "de", "a"),
    (6, "repeated row", "en", "a"),
    (6, "repeated row", "en", "a"),
    (6, "same id, other text", "en", "b"),
    (7, "é ñ ü “quoted” 日本語 ☃ \x00 end", "fr", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use themselves."""
    extra = "text_key long, f long, key long, score double, spans string, rank int, a string"
    rows = [(*r, len(r[1] or ""), 1, 2, 3, 0.5, "x", 9, "y") for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
