import pytest
from oracle import connect, rows

from tidewater import registry


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_duckdb(spark, sf, duck, name):
    got = rows(registry.QUERIES[name](spark, sf).toPandas())
    if name in registry.SQL:
        assert got == rows(duck.sql(registry.SQL[name]).df())
    else:
        assert got[1]


def test_ann_recall(spark, sf):
    assert registry.ann_recall(spark, sf).first()[0] >= 0.9


def test_filters_reach_the_scan(spark, sf):
    plan = registry.QUERIES["filter_range_pk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey" in plan and "o_totalprice" not in plan


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
