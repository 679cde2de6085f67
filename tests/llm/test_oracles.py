import pytest

from airloom.llm import registry

from ..oracle import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF), registry.oracle_sql()[name], connection(SF)) == ""
