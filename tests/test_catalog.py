import pytest
from compare import check
from sentrel.plans.catalog import REGISTRY
from sentrel.plans.oracle import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    check(spark, name, REGISTRY[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
def test_runs(spark, name):
    assert REGISTRY[name](spark, SF).count() > 0
