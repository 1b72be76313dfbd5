import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __text string, score double, slot int, kept_text string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with those that operators use inside."""

    def make(texts, ids=None, langs=None, parts=2):
        rows = [((i if ids is None else ids[i]), t, None if langs is None else langs[i], "s", None, "x", 1.0, 2, "y") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS).repartition(parts) if rows else spark.createDataFrame([], DOCS)

    return make
