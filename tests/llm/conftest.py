import pytest
from cases import ODD

DOCS = "doc_id long, text string, block long, spans string, kept string, score double"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text) with further columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(d, t, 1, "x", "y", 0.5) for d, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)
