import pytest

ODD = [
    (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", "a", 4),
    (5, "The cat sat on the mat and looked at the moon for a while.", "en", "b", 1),
    (5, "The cat sat on the mat and looked at the moon for a while.", "en", "b", 1),
    (None, "The cat sat on the mat and looked at the moon for a while.", "en", "b", 1),
    (6, "x" * 200_000, "en", "c", 1),
    (7, "naïve Ångström straße 123 Σας ½ \x1c 日本語", "de", "c", 1),
    (8, "one two " * 30_000, "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, repeats, empty and very long texts, and columns named like results."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "1 as score", "'z' as node", "0 as n_words", "true as kept", "2 as h", "3 as item_id")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
