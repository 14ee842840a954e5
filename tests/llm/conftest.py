import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, row string"

#: Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names.
HARD = [
    (1, "The first text stands here for a while and says nothing of note.", "en", "a", 64, "x", "y", "z"),
    (2, "The first text stands here for a while and says nothing of note.", "en", "a", 64, "x", "y", "z"),
    (2, "The first text stands here for a while and says nothing of note.", "en", "a", 64, "x", "y", "z"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, None, None, None),
    (5, " \t\n", "en", None, 3, None, None, None),
    (None, "A row without an id keeps its words all the same.", "en", "b", 49, None, None, None),
    (None, None, None, None, None, None, None, None),
    (6, "long " * 20_000 + "end", "en", "c", 100_003, None, None, None),
    (7, "x" * 50_000, None, "c", 50_000, None, None, None),
    (8, "12 34 5678 😀 ünï çödé", "fr", "c", 22, None, None, None),
]


@pytest.fixture
def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
