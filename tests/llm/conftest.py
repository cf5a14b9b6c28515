import os
import tempfile

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
EN = "the quick brown fox jumps over the lazy dog and then the other dog was with them"
DE = "der schnelle braune fuchs springt über den faulen hund und dann ist der andere hund auch müde"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows and one very long text."""
    rows = [(1, EN, "en", "a", 80), (2, DE, "de", "b", 90), (2, DE, "de", "b", 90), (None, EN, None, None, None), (None, None, None, None, None),
            (3, "", "en", "", 0), (4, " \t\n ", None, "a", 4), (5, "12 34 ... 56", "en", "a", 12), (6, None, "de", None, None),
            (7, "x" * 50_000, "en", "c", 50_000), (8, (EN + "\n") * 3_000, "en", "c", None), (9, "▁ \U0001F600 \x00é", "de", "d", 5),
            (10, "Привет мир", "en", "a", 10)]
    return rows + [(i, f"{EN} {i} {DE if i % 2 else EN}", "en" if i % 2 else "de", f"s{i % 7}", 1) for i in range(20, 60)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with more columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    from tilescope.session import ship_code
    ship_code(spark)
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("size", "slot", "shard", "n", "h", "fp", "score", "ids", "position", "target", "_h", "_text", "label", "key", "line", "site",
                 "_n_lines", "_n_removed", "_language", "_doc", "_key", "doc", "language", "n_lines", "_lines", "_removed", "_stays", "_identity"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def write(spark, df, name):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    df.write.parquet(path)
    return spark.read.parquet(path)
