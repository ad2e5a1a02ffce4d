import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, word string, line string, items string"


@pytest.fixture
def docs(spark):
    """A documents table from texts, or from (doc_id, text); its further columns have clashing names."""

    def make(*texts):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame([(*x[:2], x[2] if len(x) > 2 else None, x[3] if len(x) > 3 else None, None, "k", "w", "l", "i") for x in rows], DOCS)

    return make
