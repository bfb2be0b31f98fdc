"""Plans of queries over polygons: an expression of a polygon must not be repeated in them many times over."""

import __spark_entry__ as entry
from conftest import SF


def plan_length(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_sampling_grid(spark):
    assert plan_length(entry.queries()["b19_sampling_grid"](spark, SF)) < 10_000


def test_polygon_faults(spark):
    assert plan_length(entry.queries()["b2_polygon_faults"](spark, SF)) < 60_000
