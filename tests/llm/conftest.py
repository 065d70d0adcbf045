import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and other columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `_id` string, `_text` string, members int, `keep_id` string, text_sha256 string, score double"
    long = "alpha beta gamma delta " * 6000
    rows = [
        (1, "one two three four five six seven", "en", "a", 10, "x", "y", 1, "k", "s", 0.5),
        (1, "one two three four five six seven", "en", "a", 10, "x", "y", 1, "k", "s", 0.5),
        (2, "one two three four five six seven", "en", "a", 10, None, None, None, None, None, None),
        (3, None, None, None, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, None, None, 3, None, None, 1.0),
        (None, "lost id", "fr", "b", 7, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None, None, None),
        (6, long, "en", "a", len(long), None, None, None, None, None, None),
        (7, long + "x", "en", "a", len(long) + 1, None, None, None, None, None, None),
        (8, "   \n\t ", "de", "c", 6, None, None, None, None, None, None),
        (9, "été déjà 🙂 ﬁn", "fr", "c", 14, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
