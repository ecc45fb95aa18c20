import pyarrow as pa
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, x, lang, "s", len(x or "")) for i, x in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, a very long text, rare characters."""
    return [(1, None), (2, ""), (3, " \n\t "), (None, "a null id here"), (4, "same text twice over"), (4, "same text twice over"), (5, "word " * 30000), (6, "日本 語 é́ x²\x1c\u2003y"), (7, "!!!")]


def chunk(texts, lower=False):
    from notemill.llm import textcore as tc

    return next(tc.chunks(pa.array(texts, pa.large_string()), lower, 1 << 40))[2]
