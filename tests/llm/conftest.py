import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, host string"

PARAGRAPH = " ".join(f"w{i}" for i in range(60))
#: Nulls, empty and long texts, ties, repeated rows, columns whose names clash with the operators' own.
ODD = [
    (1, None, "en", "a", 0, "x", "h"),
    (2, "", "en", None, 0, "x", "h"),
    (3, "   \n\n \t", None, "a", 5, None, None),
    (4, "one two", "en", "a", 7, "x", "h"),
    (5, PARAGRAPH, "en", "a", 9, "x", "h"),
    (5, PARAGRAPH, "en", "a", 9, "x", "h"),
    (6, PARAGRAPH + " tail\nline\nline\n\nline", "de", "b", 9, "x", "h"),
    (None, "A null id with é and ß and 漢字 " + PARAGRAPH.upper(), "de", "b", 9, "x", "h"),
    (7, ("long text " * 40 + "\n") * 300, "fr", "b", 9, "x", "h"),
    (8, "<|endoftext|> it's  50% of   x<|endoftext|>\r\n\tend \U0001f600", "fr", "b", 9, "x", "h"),
    (9, "x" * 5000, "fr", "b", 9, "x", "h"),
    (10, "123 456 !!! ???", "es", "c", 9, "x", "h"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
