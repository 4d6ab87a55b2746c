import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf(spark):
    return SF


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty, wordless, very long and repeated texts, clashing column names."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30_000))
    rows = [(1, "The cat sat on the mat. Über Äpfel\nline two", "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0),
            (4, "%%% ### ...", "xx", "b", 11), (5, long, "en", "b", len(long)), (6, "one two", "en", "c", 7),
            (6, "one two", "en", "c", 7), (None, "id is null here", "en", "c", 1), (7, "a\0b \t\r\n  c  ", None, "d", 3),
            (8, "same text in two rows of different ids", "en", "a", 1), (9, "same text in two rows of different ids", "en", "b", 1)]
    rows = [r + ("x", 1, "y", [1]) for r in rows]
    return spark.createDataFrame(rows, DOCS + ", member string, id int, label string, keys array<int>").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def words(rng, n, size=5):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n)]
