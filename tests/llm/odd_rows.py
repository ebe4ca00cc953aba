import pytest

#: Rows every operator must take: null id, null text, empty and blank texts, repeated rows, a very long text.
ODD = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " \n\t "), (None, "x y"), (5, "word " * 30_000), (6, "é ß 漢字 😀")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", "en", "s") for i, t in ODD], "doc_id long, text string, n_words string, lang string, source string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


def rows(df):
    return [tuple(r) for r in df.collect()]
