import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeats and clashing extra columns."""
    rows = [
        (0, "the cat sat on the mat and the dog sat on the rug", "en", "a", 49, 1.0, "x"),
        (1, "the cat sat on the mat and the dog sat on the rug", "en", "a", 49, 2.0, "y"),
        (2, "", "en", "b", 0, None, None),
        (3, None, None, None, None, None, None),
        (4, "  \n\t ", "fr", "b", 5, 0.5, "z"),
        (5, "le chat est sur la table et le chien dort " * 3000, "fr", "c", 126000, 0.1, "w"),
        (6, "12345 !!! ???", None, "c", 13, 0.2, ""),
        (7, "it's we'll they've '' 's x  y\n\n z   é\U0001f642中", "en", None, 40, 0.3, "q"),
        (7, "it's we'll they've '' 's x  y\n\n z   é\U0001f642中", "en", None, 40, 0.3, "q"),
        (None, "a text without a number", "en", "d", 23, 0.4, "n"),
        (9, "x" * 70000, "de", "d", 70000, 0.6, "l"),
        (10, "one two three", "en", "e", 13, 0.7, "s"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, length string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double, length string")
