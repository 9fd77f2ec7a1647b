import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
LONG = "lorem ipsum dolor sit amet " * 3000
#: Nulls, empty and long texts, ties, repeated rows, other scripts.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 36), (2, "alpha BETA gamma delta epsilon zeta.", "en", "a", 36), (3, None, None, None, None), (4, "", "en", "a", 0),
    (5, LONG, "en", "b", len(LONG)), (5, LONG, "en", "b", len(LONG)), (None, "alpha beta gamma delta epsilon zeta.", "en", None, 36), (6, "été où naïve 漢字 ☃ <|endoftext|>", "fr", "c", 30),
    (7, "one", "en", "a", 3), (8, "\n\n  \t\n", "en", "a", 6), (9, "It's 12345 o'clock now here", "en", "d", 28), (10, LONG[:-5] + "x y", "en", "b", len(LONG) - 2),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns under names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("digest", "row_id", "keep_id", "fp", "n", "word", "uid", "length", "range", "place", "score", "h", "id", "row_key", "root", "ids", "start", "quality", "__key", "__digest", "__score", "__spans", "__places", "__told", "__keep", "__batch", "__size")
    return odd.withColumns({c: F.lit("x") for c in names})
