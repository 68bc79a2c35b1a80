import pytest

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, fp string, uid long, key string, component_id long, tokens long"

LONG = "the quick brown fox jumps over the lazy dog while seven wizards boil tea near the old stone bridge"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and names that clash."""
    rows = [
        (None, 1, "en", "src0", 0, "x", 9, "k", 7, 3),
        ("", 2, None, None, None, None, None, None, None, None),
        (LONG, 3, "en", "src0", 10, "x", 9, "k", 7, 3),
        (LONG, 3, "en", "src0", 10, "x", 9, "k", 7, 3),
        (LONG, 4, "en", "src1", 10, "x", 9, "k", 7, 3),
        (LONG.replace("seven", "eight"), 5, "de", "src1", 10, "x", 9, "k", 7, 3),
        (LONG, None, "de", "other", 10, "x", 9, "k", 7, 3),
        ("a " * 30000, 6, "fr", "src2", 10, "x", 9, "k", 7, 3),
        ("x" * 50000, 7, "fr", "src2", 10, "x", 9, "k", 7, 3),
        ("\n\n \n", 8, "fr", "src2", 10, "x", 9, "k", 7, 3),
        ("mail a.b@c.de, ip 10.0.0.1, card 4111 1111 1111 1111, +49 (30) 1234567\n" + LONG + "\n" + LONG, 9, "es", "src3", 10, "x", 9, "k", 7, 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
