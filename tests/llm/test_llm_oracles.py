import pytest
from compare import same
from compare import DATA

from skylathe.llm.queries import ORACLES, QUERIES


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    same(spark, DATA, QUERIES[name], ORACLES[name])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0
