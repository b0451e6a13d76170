import pytest

from tagloom.llm import queries
from tests.compare import assert_same

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), SQL[name], sf_dir)
