import pytest

ODD = [None, "", " \t\n", "a", "A a A a", "Éa ça", "The Quick brown fox jumps over the lazy dog and runs far away from here today " * 3, "x" * 5000, "w1 w2 " * 3000, "the same words", "THE SAME words", "the same words"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    rows = [(k if k != 3 else None, t, None if k % 4 == 0 else f"s{k % 3}", None if k == 5 else "en", 1, "x", 0) for k, t in enumerate(ODD)]
    rows.append(rows[9])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long, key string, size int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
