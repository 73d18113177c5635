import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Nulls, empty and blank texts, a long text, ties, repeated rows, copies and near copies.
ROWS = [
    (10, "One two three four five six.", "en", "b", 28),
    (11, "One  two three\tfour five six.", "en", "a", 29),
    (12, "One two three four five six.", "en", None, 28),
    (12, "One two three four five six.", "en", None, 28),
    (13, None, "en", "a", None),
    (14, "", "en", "a", 0),
    (15, " \n\t ", None, "a", 4),
    (16, "word " * 60_000 + "end", "en", "c", 300_003),
    (17, "Été où la forêt dort", "fr", "é", 20),
    (None, "One two three four five six.", None, None, None),
    (None, "quelque chose de nouveau", "fr", "b", 24),
    (18, "Mail a.b@c.de or 10.0.0.1\nLicensed under the Apache License, Version 2.0.", "en", "b", 70),
    (19, "MIT license, GNU General\nPublic License; cc by", "en", "b", 45),
    (-3, "1234567890 +1 (269) 555-3296 4539 1488 0343 6467", "en", "b", 48),
]
# Names that the operators use themselves.
CLASHING = ("score", "kept", "row", "size", "keep_id", "__id", "__t", "fp", "list", "digest", "html")


@pytest.fixture
def odd_docs(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def rows():
    return ROWS
