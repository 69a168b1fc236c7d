"""Golden values of lookups that SQL has no short form for."""

import pytest
from pyspark.sql import functions as F

from quire.operators import lookups as L
from quire.plans import registry


def test_nearby_boxes(spark):
    boxes = [(0.5, 0.0, 0.6, 0.02), (0.0, 0.0, 0.1, 0.02), (0.105, 0.0, 0.2, 0.02), (0.0, 0.5, 0.1, 0.52), (0.3, 0.0, 0.4, 0.02), (0.0, 0.525, 0.05, 0.54)]
    df = spark.createDataFrame([(boxes,), ([],)], "boxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = [[(b["x0"], b["y0"], b["x1"], b["y1"]) for b in r[0]] for r in df.select(L.nearby_boxes(F.col("boxes"))).collect()]
    assert got == [[(0.0, 0.0, 0.2, 0.02), (0.3, 0.0, 0.4, 0.02), (0.5, 0.0, 0.6, 0.02), (0.0, 0.5, 0.1, 0.54)], []]


@pytest.mark.parametrize("scope,seen,allowed", [(L.TenantScope("a"), 1, [True, False, False]), (L.TenantScope("a", admin=True), 3, [True] * 3), (L.TenantScope("a", production=False), 1, [True] * 3)])
def test_tenant_scope(spark, scope, seen, allowed):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "job_id long, tenant_id string").coalesce(1)
    assert scope.visible(df).count() == seen
    assert [r["allowed"] for r in scope.asked(df).orderBy("job_id").collect()] == allowed


def test_registered_models_beyond_a_million_parts(spark, tmp_path):
    """New numbers that parts have too, numbers that occur twice and none at all: the rows of the SQL twin."""
    import duckdb

    numbers = [*range(12), 10, 10, 4, -10, None, *range(1000000, 1000012), 1000004, 2000000]
    rows = [(n, "large" if i % 2 else "Small", i, None if i == 7 else 900.0 + i) for i, n in enumerate(numbers)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["j7_registered_models"]).fetchall()
    got = registry.queries()["j7_registered_models"](spark, str(tmp_path)).select("version_id", "kind", "f1", "is_active").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_orders_are_dealt_before_their_fields_are_checked(spark):
    from quire.plans.lookups import n6_cross_field

    plan = n6_cross_field(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(o_orderkey") == 1  # of three columns; the checks come after it
