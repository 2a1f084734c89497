import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(texts or (doc_id, text) pairs, **columns): a table with the columns of documents."""

    def make(texts, langs=None, sources=None):
        rows = []
        for i, t in enumerate(texts):
            i, t = t if isinstance(t, tuple) else (i, t)
            rows.append((i, t, langs[len(rows)] if langs else "en", sources[len(rows)] if sources else "s", len(t) if t is not None else None))
        return spark.createDataFrame(rows, DOCS)

    return make
