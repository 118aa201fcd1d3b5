import pytest
from oracle import check, connection
from tracelake.llm import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, connection(SF), queries()[name], oracle_sql()[name], SF)
