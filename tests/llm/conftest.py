"""Rows that operators must bear: nulls, empty and long texts, repeated rows, extra columns of clashing names."""

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, "The cat sat on the mat and looked at the dog.", "en", "a", 44), (2, "", "en", "a", 0), (3, None, None, None, None), (4, "12345 !!! 678", "xx", "b", 13),
        (5, "word " * 6000, "en", "c", 30000), (6, "The cat sat on the mat and looked at the dog.", "en", "c", 44), (6, "The cat sat on the mat and looked at the dog.", "en", "c", 44),
        (None, "le chat est sur la table", "fr", None, 24), (7, "日本語のテキスト 🙂 é x\n\n\ty", "ja", "d", 20), (8, "x" * 3000, "en", "d", 3000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "fp", "score", "word", "key", "node"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
