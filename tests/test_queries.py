import pytest
from oracles import same

from textloom import queries_tables  # noqa: F401  registers all queries
from textloom import registry as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, small, name):
    df = Q.QUERIES[name](spark, small)
    if name in Q.ORACLES:
        same(df, Q.ORACLES[name], small)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_python_in_plans(spark, small):
    for name in ("kw_category_counts", "interval_overlap", "stats_pivot", "bio_chunks", "gazetteer_tag"):
        plan = Q.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
