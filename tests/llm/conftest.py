import pytest

LONG = " ".join(f"word{i} and the" for i in range(4000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    base = "the cat and the dog of this house are in the garden with a bird that sings to them"
    rows = [
        (1, base, "en", "a", 1, 7), (2, base, "en", "a", 2, 7), (2, base, "en", "a", 2, 7), (3, base.replace(" ", "  "), "en", None, 3, 7), (4, None, "de", "b", None, 7), (5, "", None, "b", 0, 7),
        (None, base + " today", "fr", "b", 1, 7), (None, None, None, None, None, None), (6, " \n\t", "en", "c", 1, 7), (7, LONG, "en", "c", 1, 7), (8, LONG + " end", "en", "a", 1, 7), (9, "über straße ist nicht", "de", "a", 1, 7), (10, "1234 !!", "de", "b", 1, 7),
        (11, "one two", "en", "b", 1, 7), (12, "one two", "en", "b", 1, 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
