import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, a clashing column."""
    rows = [
        (1, "", "en", "s", 0),
        (2, None, None, None, None),
        (3, "a b c", "en", "s", 5),
        (3, "a b c", "en", "s", 5),
        (None, "a  b\tc", "en", "s", 6),
        (4, " ".join(f"word{i % 977}" for i in range(20000)), "en", "s", 1),
        (5, "one two three four five six", "en", "s", 27),
        (6, "é😀 \n\n\tx  y", "fr", "s", 9),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from pyspark.sql import functions as F

    return frame.withColumns({"score": F.lit("kept?"), "n_tokens": F.lit("x"), "key": F.lit(1), "shape": F.lit(2)})
