import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and then" for i in range(20_000))
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, long, "en", "a", len(long)), (5, "one two three four five six", "en", "b", 27), (5, "one two three four five six", "en", "b", 27), (6, "one two three four five six", "en", "b", 27), (None, "no id at all here", "de", "a", 17), (7, "é😀 ñ\u0085x y", "fr", "a", 9)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With further columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCS)
    for name in ("row", "hits", "host", "path", "comp", "fp", "word", "n", "size", "body", "place", "kept", "holes", "code", "row_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
