import pytest

TEXTS = [None, "", " ", "Aa", "aA", "AA", "aa", "Ää", "ÄÄ", "x" * 9000, "word " * 4000, "<|endoftext|> inside", "naïve 漢字 \x00 🙂",
         "a\r\n\tb  c   ", "it's we'll 123 4567 !!??"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with null ids and texts, repeated rows, empty and long texts, and extra columns whose
    names are used inside the operators."""
    rows = [(i, t, "k", 1.0, "d") for i, t in enumerate(TEXTS)]
    rows += [(None, "Aa", None, None, None), (None, None, None, None, None), (3, "Aa", "k", 1.0, "d"), (3, "Aa", "k", 1.0, "d")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n double, digest string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, id string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
