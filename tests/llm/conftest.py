import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases: null and empty texts, nulls elsewhere, ties, a long text, a column with a clashing name."""
    base = "one two three four five six seven eight nine ten " * 4
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(0, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (2, " \n\t ", None, "a", 4, None), (3, words, "en", "b", 1, "y"), (4, words, "en", None, 1, "y"), (5, words + " and a tail", "en", "b", 1, "y"), (6, base, "de", "b", 1, "y"), (7, "Short ÄÖ text", "de", "c", 1, "y"), (8, words.replace("w7 ", "W7 "), "fr", "c", 1, "y"), (9, "längerer Text über Züge. " * 4000, "de", "c", 1, "y"), (10, "###### |||| \n\nline a b\nline a b\nline a b\n", "en", "c", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
