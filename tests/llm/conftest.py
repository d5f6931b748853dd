import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture
def odd(frame):
    """Nulls, empty and long texts, repeated rows, a repeated id, and columns whose names operators use inside."""
    long = " ".join(f"word{i % 97}x{i % 89}" for i in range(20_000))
    rows = [
        (1, "one two three", "en", "a"), (1, "one two three", "en", "a"), (2, None, "en", None), (3, "", None, "b"),
        (4, " \t\n ", "fr", "b"), (None, "no id here", "en", "a"), (5, long, "en", "c"), (6, long + " end", "de", "c"),
        (7, "12 34 !!", "en", None), (1, "another text of id one", "fr", "a"),
    ]
    extra = "id bigint, text_ string, f bigint, hash string, block int, draws string, size int, n_words int, target double, found_ int, mark int, at int"
    return frame(f"{DOCS}, {extra}", [(i, t, l, s, len(t or ""), 0, "x", 0, "x", 0, "x", 0, 0, 0.0, 0, 0, 0) for i, t, l, s in rows])
