import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, size=40):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(r.randint(2, 9))) for _ in range(size)]
    return " ".join(r.choice(pool) for _ in range(n))


def awkward():
    """Nulls in any column, empty and long texts, ties and repeated rows, near copies and shared passages."""
    passage = words(60, 99, 500)
    long_text = words(30_000, 5, 3000)
    rows = [
        (1, words(80, 1), "en", "a"), (2, words(80, 1), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, "   \n\t ", "de", "b"),
        (6, long_text, "en", "c"), (7, long_text + " tail", "en", "c"), (8, words(60, 2), "fr", None), (9, "one", "fr", "a"), (10, "one two", "fr", "a"),
        (11, words(40, 3) + " " + passage + " " + words(30, 4), "en", "a"), (12, words(50, 6) + "\n" + passage, "en", "a"), (13, passage, "en", "z"),
        (13, passage, "en", "z"), (13, words(70, 7), "en", "z"), (None, passage, "en", "b"), (None, None, None, None),
        (14, "spam " * 500, "en", "b"), (15, "1 2-3" * 4000, "en", "a"), (16, "same line here\n" * 60, "en", "a"),
    ]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns that bear the names of computed ones."""
    rows = [(i, t, s, "x", 1, True, "y", 2.0) for i, t, _, s, _ in awkward()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, n_hit int, KEPT boolean, spans string, target double")
