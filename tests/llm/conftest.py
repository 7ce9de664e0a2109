import pytest

#: Rows that every document operator must take: nulls everywhere, empty, blank, long, repeated and tied texts.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, label int"


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
    return [
        (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 1, "x", 1),
        (2, "the quick brown fox jumps over the lazy dog " * 3, "en", "b", 1, "x", 1),
        (2, "the quick brown fox jumps over the lazy dog " * 3, "en", "b", 1, "x", 1),
        (3, None, None, None, None, None, None),
        (None, "some text with a null id", "en", "a", 3, None, 0),
        (None, None, None, None, None, None, None),
        (4, "", "de", "a", 0, "y", 0),
        (5, " \n\t \n", "de", "c", 4, "y", 0),
        (6, "12345 678 !!! ???", "fr", "c", 4, "y", 0),
        (7, long, "en", "d", len(long), "y", 0),
        (8, long + " end", "en", "d", len(long), "y", 0),
        (9, "a" * 30_000, "en", "d", 30_000, "y", 0),
        (10, "naïve café \u2014 \U0001f600 \u00a0 nbsp\u2028sep", "fr", "e", 9, "y", 0),
        (11, "x", "en", "e", 1, "y", 0),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
