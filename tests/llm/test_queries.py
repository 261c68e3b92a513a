import pytest
from compare import check
from sentrel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    check(spark, name, QUERIES[name], ORACLES[name], SF)
