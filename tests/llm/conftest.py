import pytest

EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b c d"), (5, "a b c d"), (6, "A b C d"),
    (None, "a b c d"), (None, None), (7, "ü. Straße été 日本 \U0001f600"), (8, "word " * 3000), (9, "x" * 20000),
    (10, "the cat sat on the mat and the dog ran off " * 6),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names the operators use."""
    rows = [(i, t, "en", "s", 0, 1, 2, 3.0) for i, t in EDGE]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, _body int, n_words int, score double"
    )


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
