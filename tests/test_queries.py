import pytest

from parcelflow.queries import ORACLES, QUERIES

from .compare import connection, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLES[name])
