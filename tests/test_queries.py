import pytest

from geoloom import item_queries, more_queries, queries, shape_queries


MODULES = (queries, more_queries, shape_queries, item_queries)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLE_SQL = {n: sql for m in MODULES for n, sql in m.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, same, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE_SQL:
        same(df, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_spatial_join_has_no_cross_join(spark):
    from geoloom.operators.spatial import candidate_pairs

    df = spark.range(1000).selectExpr("id", "id / 10 AS minx", "id / 10 AS miny", "id / 10 + 1 AS maxx", "id / 10 + 1 AS maxy")
    plan = candidate_pairs(df, df, cell=1.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
