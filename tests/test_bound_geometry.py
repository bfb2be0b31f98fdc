"""Steps of a geometry are worked out once a row."""

from pyspark.sql import functions as F

from landspark.functions import geometry as g


def test_edges_and_angles_are_bound(spark):
    shape = "array(array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 0D, 'y', 9D), named_struct('x', 9D, 'y', 9D))))"
    row = spark.range(1).selectExpr(f"{shape} AS geom")
    centre = row.select(g.centroid(F.col("geom")).alias("c"))
    assert tuple(centre.first().c) == (3.0, 6.0)
    assert centre._jdf.queryExecution().optimizedPlan().toString().count("zip_with") <= 2
    w = spark.range(1).select(g.to_4326(F.col("id") + 500000.0, F.col("id") + 300000.0).alias("w"))
    assert w._jdf.queryExecution().optimizedPlan().toString().count("COSH") <= 5
