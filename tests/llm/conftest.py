import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, path string, rules string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    long = " ".join(f"w{i % 5003}" for i in range(60_000))
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, "   \n\t", "en", None), (3, "one two three", "en", "a"), (3, "one two three", "en", "a"), (4, "ONE two three", None, "a"), (5, long, "en", "b"), (6, long, "fr", "b"), (None, "one two three", "en", "a"), (7, "!!! 123 ???", "de", ""), (8, "a", "en", "z")]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 0.5, "x", "y") for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
