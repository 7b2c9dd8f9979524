import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part long, `a.b` string"


@pytest.fixture
def docs(spark):
    """Builds documents from texts; columns with clashing names are added, and nulls are given in all but the first."""

    def build(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, None, "src0", None, 7, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC_SCHEMA)

    return build
