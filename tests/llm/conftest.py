import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(texts, start=0):
        rows = [(start + k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
