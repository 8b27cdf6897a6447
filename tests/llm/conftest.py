import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, control characters."""
    long = " ".join(f"word{i % 977} thé {i}" for i in range(40_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog", "en", "b", 43), (1, "The quick brown fox jumps over the lazy dog", "en", "b", 43), (2, None, "de", None, None), (3, "", None, "a", 0), (None, "no id at all", "en", "a", 12),
        (4, " \t\n ", "en", None, 4), (5, long, "en", "a", len(long)), (6, "<|endoftext|> and <s> \0 x 日本語 ﬁ", "fr", "c", None), (7, "it's we'll I'VE  two  blanks\n\n'tis ", "en", "c", 1), (8, "12345 67 $%&", None, "a", 2), (9, "THE QUICK brown fox jumps over the lazy dog", "en", "b", 43),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["size", "fp", "failures", "n_words", "task", "open", "key", "a", "b", "node", "root", "host", "bucket", "share", "k", "score", "lang_pred", "sequence_id", "component_id", "h", "once", "taken", "target", "row", "number", "times", "w0", "doc", "__row", "__copy", "__times", "__p", "p", "a`b.c"]
    return odd.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
