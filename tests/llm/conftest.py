import sys

import pytest

SF001 = "/root/testdata/sf0.001"


@pytest.fixture()
def frame(spark):
    """Documents from (doc_id, text, lang, source) tuples, with columns whose names operators use inside."""
    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], schema)
        return df.selectExpr("*", "doc_id AS text_key", "text AS body", "1 AS s", "2 AS n", "'x' AS h") if extra else df
    return make
