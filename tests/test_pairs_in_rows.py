"""Joins of polygons: pairs are not shuffled, nor rows of pairs of edges made."""

import __spark_entry__ as entry
from conftest import SF


def test_intersections_by_one_shuffle_of_polygons(spark):
    df = entry.queries()["c1_intersect_join"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate " not in plan
