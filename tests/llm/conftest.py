import pytest

#: Texts that any operator must take: null, empty, blanks, one word, repeats, several scripts.
ODD_TEXTS = [None, "", " \t\n", "one", "One", "a b c d", "a\x0bb\x0cc\rd", "é à ü ß 日本 語", "x" * 5000,
             "word " * 3000, "\n\n\n", "line one here\nline one here\n Line ONE here \nshort\nshort"]


@pytest.fixture
def odd_docs(spark):
    """The odd texts with repeated rows, a repeated id and columns whose
    names are those of results."""
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, 7, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [(50, "a b c d", "s0", 7, "x")] * 2 + [(51, "word " * 3000, "s1", 7, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, kept string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
