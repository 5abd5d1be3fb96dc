import pytest

from tests.llm.helpers import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, leaks int, ids string, digest string, row int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and further columns with names that operators use."""
    long_text = prose(1, 30_000)
    texts = [(0, None), (1, ""), (2, " \n\t "), (None, prose(2, 80)), (3, prose(3, 80)), (3, prose(3, 80)), (4, long_text), (5, long_text), (6, "é😀 �" * 30), (7, "x" * 50_000), (8, "a\nb\n\n")]
    return spark.createDataFrame([(i, t, None if n % 2 else "en", None, None, True, "z", 7, "q", "d", 1) for n, (i, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
