"""The operators' SQL over whole tables, as the driver compares it."""
import pytest

from hostshelf.llm import catalog
from tools.check_oracle import connect, difference

SF01 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, name):
    got = catalog.queries()[name](spark, SF01).toPandas()
    assert difference(got, connect(SF01).execute(catalog.oracle_sql()[name]).df()) == ""
