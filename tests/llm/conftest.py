import pytest


@pytest.fixture
def make_docs(spark):
    """Documents table from texts (None allowed); ids from 0, or pairs (id, text)."""

    def make(texts, source=None):
        rows = []
        for i, t in enumerate(texts):
            doc_id, text = t if isinstance(t, tuple) else (i, t)
            rows.append((doc_id, text, "en", source[i] if source else "s0", None if text is None else len(text)))
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
