import pytest

from pagewise.session import cut_lineage  # noqa: F401  the session fixture of the tests above is used


@pytest.fixture
def documents(spark):
    def build(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)

    return build
