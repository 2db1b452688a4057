import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, size long, score double, root string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names operators also use."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x", 1, 0.5, "r") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make
