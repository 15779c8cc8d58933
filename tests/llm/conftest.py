import pytest


@pytest.fixture
def documents(spark):
    """A documents table: rows (doc_id, text), and columns whose names an operator might use itself."""

    def make(rows):
        full = [(i, t, "x", "y", None if t is None else len(t), 1, 2.0, "z") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score INT, part DOUBLE, kept STRING"
        )

    return make
