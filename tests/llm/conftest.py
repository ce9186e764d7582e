import pytest


@pytest.fixture
def make(spark):
    """Rows of a table, with a column that clashes with names used inside."""

    def made(rows, schema, **more):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "'x' AS doc", "'y' AS group", "'z' AS _text", "1 AS words")

    return made


@pytest.fixture
def documents(make):
    def made(texts, first=1):
        return make([(first + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")

    return made
