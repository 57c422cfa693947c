import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, n int, count int, key string, component int"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns that clash with names used inside."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or ""), "t", 1, 2, "k", 3) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    same = "the same text in several rows of the table, long enough to be of use here " * 3
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, same), (5, same), (5, same), (6, same.upper()), (None, "no id at all here"),
        (7, long), (8, "x"), (9, "x y z"), (10, long + " more"), (11, "é ü ß 漢字 \U0001f600 <|endoftext|>"), (12, None, None, None),
        (13, "a\nb\nA \n b\n\n"), (14, "word " * 60),
    ]
