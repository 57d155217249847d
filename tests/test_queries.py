"""Every analytics query against its SQL in DuckDB, over whole tables."""

import pytest
from conftest import SF

from compare import same
from tickloom.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
