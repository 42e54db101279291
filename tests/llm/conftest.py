import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"word{i % 701}x{i}" for i in range(4000))

EDGE = [
    (None, "A text without an id has a few words of its own to count here.", "en", "s1", 1),
    (1, None, "en", "s1", None),
    (2, "", None, "s1", 0),
    (3, " \t\n\x0b\x0c\r", "en", None, 6),
    (4, "one", "en", "s2", 3),
    (5, "Rows that repeat are units of their own, whatever is in them, and ties are no harm.", "en", "s2", 9),
    (5, "Rows that repeat are units of their own, whatever is in them, and ties are no harm.", "en", "s2", 9),
    (6, "Élan vital größe ß ñandú    　 日本語 \x1c\x1f á İ Σ", "fr", "s3", 9),
    (7, LONG, "en", "s3", 9),
    (8, "12 34 ### $$$ | <> & %", "xx", "s3", 9),
    (9, "<|endoftext|> is <|ENDOFTEXT|>, it's we'll 123.45!? 'S", "en", "", 9),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def clashing(edge):
    """The edge rows with more columns, named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = [
        "size", "rank", "part", "print", "node", "root", "key", "kept", "n_words", "w", "h", "gid", "blob", "spans", "path",
        "edits", "tree_key", "component_id", "copies", "level", "_n", "_id", "seeds", "held_out", "score", "taken", "row_key",
    ]
    return edge.select("*", *[F.lit(f"other {n}").alias(n) for n in names])
