import pytest

TRICKY = [None, "", "   ", "\t\n", "one", "One two THREE", "é ß Σ", "a\xa0b \x1c c", "x" * 5000, "w " * 3000, "the quick brown fox jumps over the lazy dog again and again until night falls", "the quick brown fox jumps over the lazy dog again and again until night falls"]


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns with clashing names."""
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k % 2}", k) for k, t in enumerate(TRICKY)]
    rows += [(None, "no key here", "de", "src1", 1), (4, "one", "en", "src0", 4), (4, "one", "en", "src0", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long")


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.where("false")
