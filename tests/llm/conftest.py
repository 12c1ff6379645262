import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, hash long, key string, n long, size string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, source]), with columns whose names operators use, too."""

    def f(rows, parts=3):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "no", 1, "k", 2, "big") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return f

