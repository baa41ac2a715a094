import pytest


@pytest.fixture()
def docs_of(spark):
    """A documents table with an extra, clashing column."""

    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score string")

    return make


@pytest.fixture()
def odd_rows():
    """Nulls in every column, empty, wordless and long texts, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, None, None, None, None, "x", None), (None, "some text here", "en", "a", 1, None, None), (2, "", "en", None, 0, None, "s"), (3, " \t\n ", None, "a", 3, None, None),
        (4, long, "en", "b", 9, None, None), (5, "same words here again and again", "en", "a", 2, None, None), (5, "same words here again and again", "en", "a", 2, None, None), (6, "\U0001f600 ### 123", "fr", "c", 4, None, None),
    ]
