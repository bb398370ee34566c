import pytest

CLASH = ", 'x' AS score, 1 AS rank, 2 AS row, 'y' AS cls, 'z' AS ids, 3 AS length, 4 AS b, 'w' AS term, 5 AS n, 'v' AS first, 6 AS key"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    passage = "\n".join(f"{line} {k}" for k in range(3))  # 63 words
    copy = "the same words stand in this text and in its copy, " * 12
    rows = [
        (1, "short text", "en"), (1, "short text", "en"), (2, None, None), (3, "", "en"), (None, "no id here but words enough for a shingle", "en"),
        (4, "  \n\t \n", None), (5, f"intro one\n{passage}\nend one", "en"), (6, f"intro two\n\n{passage}\n\nend two", "de"),
        (7, copy, "en"), (8, copy, "en"), (9, copy + " more", "fr"), (10, "word " * 30_000, "en"), (11, "12345 !!! ...", "en"),
        (12, "Ünïcödé ñandú Straße \U0001F600 日本語 " * 5, "de"), (13, "a\x01b \x00 c", None), (14, "don't stop, it's 3.14!\n" * 3, "en"),
        (15, "one line alone again\n" * 40, "en"), (1, "another text under a repeated id", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *CLASH.strip(", ").split(", "))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
