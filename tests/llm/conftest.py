import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, bits string, part string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names operators use inside."""
    passage = " ".join(f"w{i}" for i in range(120))
    long = " ".join(f"v{i % 997}x{i}" for i in range(30_000))
    rows = [
        (1, passage + " one two three", "en"), (2, passage + " one two three", "en"), (3, "A B " + passage.upper(), None), (4, None, "en"),
        (5, "", "fr"), (6, " \n\t ", "fr"), (7, "x", None), (8, "x", "de"), (9, long, "en"), (10, long + " end", "en"), (None, passage, "en"), (2, passage + " one two three", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", None, "id", "bits", "part") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
