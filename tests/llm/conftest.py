"""Small documents with the cases that operators must stand."""

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven old owls watch from their high dark tree near that cold river bank".split()

#: Names that operators use inside themselves.
CLASHING = "src target source_size epochs budget cut_b last_key last_draw start _key _nth _size _draw _source _times _gone _twice own nth id draw h shard g r row hub labelled".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, clashing extra columns."""
    body = " ".join(WORDS[(i * i + 3 * i) % len(WORDS)] + str(i % 7) for i in range(200))
    rows = [
        (1, body, "en", "a", 1), (2, body, "en", "a", 1), (3, body + " tail", "en", "b", 2), (4, None, None, None, None), (5, "", "en", "b", 0),
        (6, "word", None, "a", 4), (7, "Word", "en", None, 4), (8, " \n\t ", "de", "c", 4), (9, "x" * 20_000, "de", "c", 9), (10, body * 30, "en", "a", 9),
        (None, "no id", "en", "a", 5), (11, "two words", "en", "b", 9), (11, "two words", "en", "b", 9), (12, "12345 !!! 99", "en", "a", 3), (13, "für Ärger  日本 語\r\nzwei", "de", "c", 3),
    ]
    cols = "doc_id long, text string, lang string, source string, n long"
    return spark.createDataFrame(rows, cols).selectExpr("*", "n AS size", "n AS score", "n AS at", "n AS rep", "n AS _b", "text AS part", *[f"n AS {c}" for c in CLASHING])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
