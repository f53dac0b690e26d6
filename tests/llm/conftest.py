import pytest

TRICKY = [
    (1, "alpha beta gamma delta epsilon", "en", "a"),
    (2, "alpha beta gamma delta epsilon", None, "b"),
    (3, None, None, None),
    (4, "", "de", "a"),
    (5, " \n\t ", "de", None),
    (None, "alpha beta gamma delta epsilon", "en", "a"),
    (6, "wörd " * 30000, "de", "c"),
    (7, "ends with newline\n", "en", "a"),
    (7, "ends with newline\n", "en", "a"),
    (8, "  two  spaces\n\nand blank lines \n x", "en", "b"),
    (9, "tabs\tand odd spaces <|endoftext|> done", "fr", "b"),
    (10, "ALPHA beta Gamma delta epsilon", "en", "a"),
    (11, "x" * 5000, "en", "a"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(*r, len(r[1] or ""), f"k{i}", i) for i, r in enumerate(TRICKY)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, row int")


@pytest.fixture(scope="session")
def empty(tricky):
    return tricky.limit(0)
