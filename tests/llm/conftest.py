import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, x string"


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Nulls in every column, empty, blank and very long texts, repeated rows, extra columns with names that operators use."""
    long = " ".join(f"word{i % 977}x" for i in range(60_000))
    rows = [
        (1, "A b c d e f g h i j.\nline two", "en", "a", 30, 0.5, 1, "x"), (2, None, "en", "a", None, None, None, None), (3, "", "fr", "b", 0, 1.0, 2, ""), (4, " \t\n ", None, None, 4, 0.1, 3, "y"),
        (5, "A b c d e f g h i j.\nline two", "en", "b", 30, 0.5, 4, "x"), (5, "A b c d e f g h i j.\nline two", "en", "b", 30, 0.5, 4, "x"), (None, "no id at all here, none", "en", "c", 23, 0.2, 5, "z"), (None, None, None, None, None, None, None, None),
        (6, long, "en", "a", len(long), 0.3, 6, "l"), (7, "Éric <|endoftext|>ÀÉ é  naïve don't 123 日本\x00\x1c tab\there", "fr", None, 40, 0.4, 7, "u"), (8, long + " tail", "en", "c", len(long) + 5, 0.3, 8, "l"),
    ]
    path = str(tmp_path_factory.mktemp("odd") / "docs.parquet")
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
