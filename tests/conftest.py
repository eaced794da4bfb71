import pytest

from framelode.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, partitions=4, memory="4g", name="tests")
    yield s
    s.stop()


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, source) rows, with a column whose name an operator uses inside."""

    def make(rows):
        full = [(i, t, "en", s, len(t or ""), 7) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, copies int")

    return make
