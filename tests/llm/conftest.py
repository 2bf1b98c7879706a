import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Frame of documents from texts, or (doc_id, text) pairs."""

    def make(texts, **more):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and columns whose names clash with results."""
    prose = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) + str(i % 97) for i in range(40_000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", None, "a", 6),
        (4, prose, "en", None, len(prose)),
        (5, "Hello small world of words.", "en", "b", 27),
        (5, "Hello small world of words.", "en", "b", 27),
        (None, "Hello small world of words.", "en", "c", 27),
        (6, "123 !!! 456", "de", "c", 11),
        (7, "été à la mer, où les étoiles", "fr", "c", 28),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.selectExpr(
        "*", "'x' AS score", "1 AS _text", "2 AS class", "3 AS rank", "'y' AS n_words", "'z' AS lang_pred", "4 AS _row", "'k' AS _key", "5 AS removed", "6 AS cut", "7 AS n_tokens", "8 AS root", "9 AS spans"
    )


@pytest.fixture(scope="session")
def no_docs(docs, spark):
    return spark.createDataFrame([], DOCS)
