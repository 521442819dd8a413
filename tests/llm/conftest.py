from __future__ import annotations

import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, __keep string"


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns whose names clash."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from home today "
    rows = [
        (1, base * 3, "en", "a", 1, 0.5, "x"),
        (2, base * 3, "en", "a", 1, 0.5, "x"),
        (3, base.upper() * 3, None, None, None, None, None),
        (4, None, "en", "b", 0, None, None),
        (5, "", "en", None, 0, None, None),
        (6, "   \n\t ", "de", "b", 0, None, None),
        (None, "une phrase bien différente des autres phrases ici", "fr", "c", 1, None, None),
        (8, "mot " * 40_000, "fr", "c", 1, None, None),
        (9, "1234 !!! ???", None, "c", 1, None, None),
        (10, "x" * 70_000, None, "c", 1, None, None),
        (11, "same row twice is here for all to see", "en", "b", 1, 1.0, "y"),
        (11, "same row twice is here for all to see", "en", "b", 1, 1.0, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
