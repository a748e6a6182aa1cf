import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text, source) as a table of documents with extra columns whose names clash with internal ones."""

    def build(rows):
        full = [(i, t, None, s, None, 1, 2, "x", 3.0) for i, t, s in rows]
        return spark.createDataFrame(full, DOCS + ", salt int, n int, digest string, label double")

    return build
