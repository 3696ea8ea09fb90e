import pytest

from turnstone.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("llm-tests", cpus=4)


@pytest.fixture
def docs(spark):
    """Rows that hold the odd cases: nulls, empty texts, repeated rows, a long text, extra columns."""
    rows = [
        (1, "The cat sat on the mat.", "en", "a", "x"), (2, None, "en", "a", "x"), (3, "", None, None, "x"), (4, "   \n", "en", "b", None),
        (5, "Der Hund läuft schnell nach Hause und schläft.", "de", "b", "x"), (5, "Der Hund läuft schnell nach Hause und schläft.", "de", "b", "x"),
        (6, "word " * 9000 + "The end", "en", "c", "x"), (7, "1234 !!! 567", None, "c", "x"), (8, "a", "en", None, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
