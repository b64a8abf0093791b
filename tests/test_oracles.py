import pytest
from compare import same
from compare import DATA

from skylathe import io_queries, kg_queries, op_queries, oracles, queries

Q = {**queries.QUERIES, **kg_queries.QUERIES, **op_queries.QUERIES, **io_queries.QUERIES}
O = {**oracles.ORACLES, **kg_queries.ORACLES, **op_queries.ORACLES, **io_queries.ORACLES}


def test_every_oracle_has_a_query():
    assert set(O) <= set(Q)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(O))
def test_same_as_sql(spark, name):
    same(spark, DATA, Q[name], O[name])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_no_graph_query_loops_over_pairs(spark):
    for name in kg_queries.QUERIES:
        plan = kg_queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
