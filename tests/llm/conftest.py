import pytest

LONG = " ".join(f"w{i % 997} lorem{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties and columns whose names an operator might use itself."""
    texts = [None, "", " \t\n", "one", "one two", LONG, LONG, "Ünïcode wörds здесь 日本語 text " * 8, "a\nb\na\n\nb\n", "x" * 5000, "the same words " * 30]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s", "s"][i % 3]) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", "en", None), (100, "one two", "en", "s")]
    rows = [(*r, -1, "fp", "k") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, fp string, `a.b` string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -5")
