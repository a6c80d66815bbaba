import pytest

#: Nulls in any column, empty and very long texts, ties, a repeated row, and columns whose names operators might use.
BASE = [
    (1, "The quick brown Fox", "en", "a", 19, 7, "x"), (2, "the QUICK brown fox", "en", "a", 19, 7, "x"), (3, "", "en", "b", 0, 7, "x"), (4, None, None, None, None, None, None), (5, "   \t\n ", "de", "b", 6, 7, "x"),
    (6, "über straße ÜBER " * 30, "de", "b", 510, 7, "x"), (7, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "c", 1, 7, "x"), (8, "one two three four five six seven eight nine ten eleven", "en", None, 5, 7, "x"),
    (8, "one two three four five six seven eight nine ten eleven", "en", None, 5, 7, "x"), (None, "no id here", "en", "a", 9, 7, "x"), (9, "mail me at ann@example.com or +1 (555) 123-4567 now", "en", "a", 9, 7, "x"),
    (10, "card 4111 1111 1111 1111 from 10.0.0.1 not 300.1.1.1", "en", "a", 9, 7, "x"), (11, " ".join(f"z{i}" for i in range(60)), "en", "c", 9, 7, "x"), (12, "start " + " ".join(f"z{i}" for i in range(10, 50)) + " end", "en", "c", 9, 7, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, keep_id string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(BASE, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
