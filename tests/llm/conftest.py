import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, ids string, rep long, _language string, score double, length long, _task int"
LONG = "lorem ipsum dolor sit amet " * 20_000
TEXTS = [
    (1, "One text of several plain words, said twice."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "One text of several plain words, said twice."),
    (7, "word"), (8, "word"), (None, "A text without an id, once."), (None, None), (9, "!!! ??? 123"), (10, "ünïcödé ß 漢字 don't  stop\n\n end "), (7, "word"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with names used inside."""
    rows = [(i, text, "en" if n % 3 else None, None, None, False, -1, "x", 0, "y", 2.0, 9, 3) for n, (i, text) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
