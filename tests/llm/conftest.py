import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    return make
