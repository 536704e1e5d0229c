import pytest

#: Texts that operators must bear: null, empty, white space, marks only, ties, very long.
ODD = [None, "", " \n\t ", "!!! --- ???", "one", "Same text here. " * 3, "Same text here. " * 3, "日本語 и русский 🙂 é é", "word " * 30_000, "a\x00b\x1fc"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts, a null doc_id, a repeated row, and columns whose names clash with the operators' own."""
    rows = [(k, t, "en" if k % 2 else None, "s", 0, "x", 1, None) for k, t in enumerate(ODD)]
    rows += [(None, "no id at all", None, None, None, None, None, None), (5, ODD[5], "en", "s", 0, "x", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, fp long, component_id long")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
