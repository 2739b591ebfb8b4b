import pytest


@pytest.fixture
def table(spark):
    """A small documents table; extra columns may clash with names that operators use inside."""
    def make(texts, extra=True, ids=None, source="s"):
        rows = [(ids[i] if ids else i, t, source, "x", 7) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, size int")
        return (df if extra else df.select("doc_id", "text", "source")).repartition(3)
    return make
