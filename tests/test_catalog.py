import importlib.util

import pytest

from tagloom.plans import catalog
from tests.compare import assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_sql(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, SQL[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert catalog.queries().keys() <= module.queries().keys()
    assert set(module.oracle_sql()) <= set(module.queries())


def test_filters_reach_the_scan(spark, sf_dir):
    from tagloom.plans import fixtures as fx

    df = fx.view(spark, sf_dir, "select event_id, ts from events").where("event_id > 900").select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,900)]" in plan and "ReadSchema: struct<event_id:bigint>" in plan
