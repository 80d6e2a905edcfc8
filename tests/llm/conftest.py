import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """Makes a documents table of texts (or full rows) with nulls where a field is missing."""

    def make(*rows):
        full = [(i, r, "en", f"s{i % 2}", len(r or "")) if r is None or isinstance(r, str) else (*r, *[None] * (5 - len(r))) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOC)

    return make
