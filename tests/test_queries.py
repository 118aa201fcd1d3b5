import pytest
from oracle import SF, check, connection
from tracelake.plans import queries


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    check(spark, duck, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["source_row", "tid", "kind"] and rows.count() > 0


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["f6_sequences"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan


def test_no_cross_joins(spark):
    """No query multiplies two tables; joins without keys are with one-row aggregates only."""
    for name, query in queries.QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
