import pytest


@pytest.fixture
def documents(spark):
    """Makes a documents table with a clashing extra column."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "'x' as score", "1 as n_shingles", "2 as component_id", "3 as length", "4 as s")

    return make
