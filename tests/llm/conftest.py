import pytest

ODD = [
    (1, "alpha beta", "en", "s", "g1"),
    (1, "alpha beta", "en", "s", "g1"),
    (2, "alpha  beta", None, None, "g2"),
    (None, "alpha\tbeta", "en", "s", None),
    (3, None, "en", "s", "x"),
    (4, "", "fr", None, "x"),
    (5, "   \n\t ", None, "s", "x"),
    (6, "...!?", "en", "s", "x"),
    (7, "word " * 60_000, "en", "s", "x"),
    (8, "ÀÉ ñ 漢字 \U0001f600", "es", "s", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts, languages and sources, repeated rows, empty and very long texts, and extra
    columns whose names operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, g string")
    for name in ("n", "c", "rep", "keep_id", "tok", "at", "label", "size", "_row"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
