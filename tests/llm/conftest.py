import pytest

# One row per case that every document operator must take: nulls in any column, empty,
# white space only, repeated rows, equal ids with other texts, very long, odd characters.
LONG = "Lange Wörter und kurze words, again and again. " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, "Alpha beta gamma delta epsilon.", "en", "s"),
        (2, "Alpha  beta\tgamma\ndelta epsilon.", "en", "s"),
        (3, None, None, None),
        (4, "", "en", "s"),
        (5, " \t\n ", "en", "s"),
        (6, "x", "en", "s"),
        (6, "x", "en", "s"),
        (7, "other text of the same id", "en", "s"),
        (7, "its second text", "en", None),
        (None, "a row without id", "en", "s"),
        (None, "a row without id", "en", "s"),
        (None, "x", "en", "s"),
        (8, LONG, "de", "s"),
        (9, "日本語 \U0001f600 é   nbsp line \x00 zero ¼ ²", "ja", "s"),
        (10, "Alpha beta gamma delta epsilon.", "en", "s"),
    ]
    # further columns whose names the operators use themselves
    return spark.createDataFrame(
        [(i, t, la, s, len(t or ""), "c", 0.5, 1, "k") for i, t, la, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long, "
        "_id string, score double, label int, _row_key string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
