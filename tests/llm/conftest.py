import pytest

LONG = "lorem ipsum " * 40_000
ROWS = [
    (1, "The cat sat.\nA dog ran over the hill to the far side of town today.", "en", "b", 1, 9, "k"),
    (2, "The cat sat.\nA dog ran over the hill to the near side of town today.", "en", None, 1, 9, "k"),
    (2, "The cat sat.\nA dog ran over the hill to the near side of town today.", "en", None, 1, 9, "k"),
    (3, None, None, "a", None, None, None),
    (4, "", "de", "a", 0, 0, ""),
    (5, " \t\n\x0b\f\r ", "de", "a", 7, 0, ""),
    (6, LONG, "la", "a", len(LONG), 3, "x"),
    (7, "x" * 100_000, "xx", "c", 100_000, 3, "x"),
    (8, "a  b \n c é日本語\U0001f600 <|endoftext|> it's\n\n\u3000end ", "xx", "c", 3, 3, "x"),
    (None, "no id here", "en", "b", 10, 1, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, blank and very long texts, a repeated row, and columns that clash with names the operators use."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
