import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, kept boolean, key string, label int, line string, score double, n int")


@pytest.fixture()
def docs(spark):
    """Makes a documents frame with further columns whose names the operators use themselves."""
    def make(rows):
        full = []
        for r in rows:
            doc_id, text, *rest = r
            source = rest[0] if rest else "s"
            full.append((doc_id, text, None, source, None, -1, None, "key", 7, None, float("nan"), None))
        return spark.createDataFrame(full, SCHEMA)
    return make

