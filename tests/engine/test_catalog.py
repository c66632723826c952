import pytest

from spindrift import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.01"
    same(catalog.QUERIES[name](spark, d), d, catalog.ORACLE_SQL[name])
