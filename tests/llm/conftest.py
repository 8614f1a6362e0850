import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, made string"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
#: nulls in every column, empty and very long texts, ties, repeated rows, a further column
ODD = [
    (1, "The cat sat on the mat with the other cat. Mail a.b@c.example.org or +1 (555) 123-4567", "en", "s1", 10, "x"),
    (1, "The cat sat on the mat with the other cat. Mail a.b@c.example.org or +1 (555) 123-4567", "en", "s1", 10, "x"),
    (2, "the cat sat on the mat with the other cat. mail a.b@c.example.org or +1 (555) 123-4567", None, None, None, None),
    (3, "", "en", "s1", 0, ""),
    (4, None, "de", "s2", None, None),
    (None, "Der Hund und die Katze laufen ueber die lange Strasse nach Hause", "de", "s2", 5, "y"),
    (None, None, None, None, None, None),
    (5, LONG, "en", "s1", 7, None),
    (6, "   \t\n ", "fr", "s3", 6, None),
    (7, "1234 5678 !!", "fr", "s3", 9, None),
    (8, "日本語 Ελλάδα \U0001f600 <|endoftext|> é", "xx", "s3", 9, None),
    (9, "one", None, "s1", 3, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Names that operators make for themselves, as further columns."""
    from pyspark.sql import functions as F

    names = "lang_pred score tokens topic probability kept fp mark mentions key n ids row start range rep low whole more component_id".split()
    return odd.withColumns({n: F.lit("clash") for n in names})
