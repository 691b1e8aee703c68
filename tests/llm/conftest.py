import pytest

#: Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, short texts, odd bytes.
HARD = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 10),
    (2, "the  quick brown\tfox jumps over the lazy dog again and again today", "en", "a", 10),
    (2, "the  quick brown\tfox jumps over the lazy dog again and again today", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 0),
    (6, "ein kleiner Text — mit Ünïcode 😀 \x00 und ▁", "de", None, 3),
    (7, "word", "en", "b", 4),
    (None, "a text whose id is null but which has enough words to be kept by most", "en", "c", 1),
    (8, "x" * 5000 + " " + "long words and " * 3000, "en", "c", 1),
    (9, "\n".join(["one line that repeats itself here"] * 8), "en", "a", 1),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    """Those rows, with columns of clashing names."""
    rows = spark.createDataFrame([(*r, "x", 1, "y") for r in HARD], KIND + ", `size` string, n_words int, `_words` string")
    return rows.repartition(2).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
