import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, empty, long, repeated and clashing rows, and a column no operator knows."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, node string"
        )

    return make
