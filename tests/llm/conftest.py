import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ODD = [
    (None, None),
    (None, "some text of a row without an id, long enough to be kept as it is here"),
    (1, ""),
    (2, " \n\t \r\x0b\x0c "),
    (3, "one"),
    (4, "a b c d e f g h i j k l m n o p"),
    (4, "a b c d e f g h i j k l m n o p"),
    (5, "A B C D e f g h i j k l m n o p"),
    (6, LONG),
    (7, "don't <|endoftext|> é É ß İ ΑΣ. 123 x y \x1c z 漢字 é <|startoftext|>"),
    (8, "x" * 5000),
    (9, "same line of text here now\n" * 8),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like outputs."""
    rows = [(i, t, "en", "src", 1, 2, "k", 3.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, shard int, kept string, score double")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
