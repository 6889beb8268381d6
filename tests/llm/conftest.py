import pytest

#: Null and empty texts, ties, repeated rows, a null id, a long text, and columns whose names the operators use themselves.
EDGES = [
    (1, None, "en"), (2, "", "en"), (3, "short", "en"), (4, "short", "fr"), (5, "SHORT", None), (6, "   \n\t ", "en"), (6, "   \n\t ", "en"),
    (None, "short", "en"), (7, "line a\nline b\nline c\nline d\nline e", "en"), (8, "x\nline a\nline b\nline c\nline d\ny", "de"), (8, "x\nline a\nline b\nline c\nline d\ny", "de"),
    (9, "w " * 3000 + "end", "en"), (10, "é" * 700 + " tail", "fr"), (11, "é" * 700 + " tail", "fr"),
    (12, " ".join(f"word{i}" for i in range(120)), "en"), (13, "before it " + " ".join(f"word{i}" for i in range(20, 90)) + " after it", "en"),
    (14, " ".join(f"word{i}" for i in range(118)) + " other", "en"), (15, "Nul \x00 and \U0001f600 emoji <|im_end|> <\\|x", "en"),
]


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(EDGES, "doc_id long, text string, lang string")
    clash = ("kept", "spans", "rest", "group", "digit", "salt", "row", "id", "head", "context", "kept_text", "places", "bands", "one", "two", "_id", "turns", "token_ids", "media", "doc_key", "text_key")
    return rows.withColumns({c: F.lit(1) for c in clash})


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
