import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, copies long"

#: Nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash with the operators' own.
ODD = [
    (1, "one two three", "en", "a", 13, 9, 9),
    (2, "one  two\tthree", "en", "a", 14, 9, 9),
    (3, "", "en", "b", 0, 9, 9),
    (4, None, None, None, None, None, None),
    (5, " \n", "de", None, 2, 9, 9),
    (6, "Straße naïve 東京 " * 2000, "de", "c", 1, 9, 9),
    (7, "Straße naïve 東京 " * 2000, "de", "c", 1, 9, 9),
    (7, "Straße naïve 東京 " * 2000, "de", "c", 1, 9, 9),
    (8, "x" * 300_000, "en", "a", 1, 9, 9),
    (9, "one two three", "fr", "z", 13, 9, 9),
    (None, "one two three four five six seven eight nine ten eleven", "fr", "z", 13, 9, 9),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
