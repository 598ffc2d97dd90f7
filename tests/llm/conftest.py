import pytest

LONG = "lang " * 60_000 + "end of the very long text"
TEXTS = [
    "One two three four five six seven eight nine ten.\nA line that many documents repeat again.\nend",
    "one two three four five six seven eight nine ten.\nA LINE that many documents repeat again. \nother end",
    "Something else altogether, with a card 4539578763621486 and a date 2021-03-04.\n  a line that many documents repeat again.",
    "",
    None,
    LONG,
    "same text twice, word for word, in two rows of the table",
    "same text twice, word for word, in two rows of the table",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "en", None, len(t) if t is not None else None, "x", 1, "y") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "a row without an id, a line that many documents repeat again.", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node int, doc string")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
