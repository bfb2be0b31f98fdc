"""Points in boxes, counted without pairs."""

import random

from pyspark.sql import functions as F

from landspark.operators import spatial


def test_points_in_boxes_on_borders_and_repeats(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(300)] + [("a", 5.0, 5.0)] * 70 + [("c", None, 1.0), (None, 1.0, 1.0)]
    boxes = []
    for k in range(120):
        x, y = sorted(float(rng.randrange(-1, 13)) for _ in "ab"), sorted(float(rng.randrange(-1, 13)) for _ in "ab")
        boxes.append((rng.choice("abcd"), k, x[0], y[0], x[1], y[1]))
    got = spatial.count_in_boxes(spark.createDataFrame(points, "area string, x double, y double"), spark.createDataFrame(boxes, "area string, k int, minx double, miny double, maxx double, maxy double"), "area", ["k"])
    inside = {k: sum(a == area and None not in (x, y) and x0 <= x <= x1 and y0 <= y <= y1 for area, x, y in points) for a, k, x0, y0, x1, y1 in boxes}
    assert {r.k: r.n for r in got.collect() if r.n} == {k: n for k, n in inside.items() if n}


def test_plans_do_not_meet_parcels_in_pairs(spark):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    square = lambda low, high: F.array(F.array(F.array(corner(low, low), corner(low, high), corner(high, high), corner(high, low))))
    parcels = spark.range(500).select(F.lit("1").alias("teryt_gmina"), square(4.0, 6.0).alias("geom"))
    plans = spark.range(400).select(F.lit("1").alias("teryt_gmina"), F.col("id").alias("zone_id"), square(0.0, 9.0).alias("geom"))
    df = spatial.match_plan_extents(parcels, plans)
    assert [tuple(r) for r in df.select("n_hits", "n_swapped_hits", "bbox_axes_suspect").distinct().collect()] == [(500, 500, False)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Join Inner" not in plan  # known plans and their counts; no parcel is joined
