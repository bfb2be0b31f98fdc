"""Sampling of parcels by grids of points, and of pictures by neighbourhoods of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspark.functions import geometry as g

#: A grid has so many cells a side at least; the radius of a neighbourhood if none is given.
LEAST_CELLS, RADIUS = 3, 3


def grid_cells(parcels: DataFrame, n: int, key: str = "parcel_id", geom: str = "geom") -> DataFrame:
    """(key, ix, iy, x, y, cell_area) of the cells of each parcel's n × n grid whose centre lies in the parcel (even-odd).

    The grid spans the envelope, one metre a side at least; ``n`` is three at least.  A parcel has at most n * n rows, and none
    without a geometry.
    """
    n = max(LEAST_CELLS, n)
    box = lambda b: F.struct(b["minx"].alias("x"), b["miny"].alias("y"), F.greatest(b["maxx"] - b["minx"], F.lit(1.0)).alias("w"), F.greatest(b["maxy"] - b["miny"], F.lit(1.0)).alias("h"))
    # box and edges are made once a parcel, not once a cell
    shape = lambda v: F.struct(g.edges(v).alias("edges"), g.let(g.envelope(v), box).alias("box"))

    def inner(s: Column) -> Column:
        centre = lambda axis, size, i: s["box"][axis] + (i + 0.5) * s["box"][size] / n
        index = lambda k: F.struct(F.floor(k / n).cast("int").alias("ix"), (k % n).cast("int").alias("iy"))
        cell = lambda i: F.struct(i["ix"].alias("ix"), i["iy"].alias("iy"), centre("x", "w", i["ix"]).alias("x"), centre("y", "h", i["iy"]).alias("y"), (s["box"]["w"] * s["box"]["h"] / (n * n)).alias("cell_area"))
        cells = F.transform(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), index), cell)
        return F.filter(cells, lambda c: g.edges_hold(s["edges"], c["x"], c["y"]))

    return parcels.filter(F.size(geom) > 0).select(key, F.explode(g.let(g.let(F.col(geom), shape), inner)).alias("_c")).select(key, "_c.*")


def sampled_zones(cells: DataFrame, hits: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Approximate zones: for each parcel and designation (with description, plan and resolution) its cells, their number and area.

    ``hits``: key, ix, iy, designation, description, plan_name, resolution; a cell without a hit, or with a null designation,
    belongs to no zone.  Hits that repeat a cell count once each.
    """
    named = hits.filter("designation IS NOT NULL").withColumn("description", F.coalesce("description", F.lit("")))
    rows = cells.join(named, [key, "ix", "iy"])
    return rows.groupBy(key, "designation", "description", "plan_name", "resolution").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("cell_area").alias("area"), F.array_sort(F.collect_list(F.struct("ix", "iy"))).alias("cells")
    )


def neighbourhood_mode(points: DataFrame, pixels: DataFrame, size: DataFrame, ignored: Column, radius: int = RADIUS) -> DataFrame:
    """(id, r, g, b, n) of the most frequent colour around each point, of those that are not ignored if there is one.

    ``points``: id, image_id, px, py; ``pixels``: image_id, px, py, r, g, b, one row a pixel; ``size``: image_id, width, height.
    The square of 2 * radius + 1 pixels a side is clamped to the picture, so a pixel at its edge may count several times.  Of
    colours with one count the first in order of columns and then rows stands first.  Each point makes a bounded number of keys,
    so pictures are never joined with points as a whole.  Points without a picture, or with a null place, have no row.
    """
    side = 2 * radius + 1
    rows = points.filter("px IS NOT NULL AND py IS NOT NULL").join(size, "image_id").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    within = lambda c, d, most: F.greatest(F.lit(0), F.least(F.col(most) - 1, F.col(c) + d - radius)).cast("int")
    keys = rows.select("id", "image_id", "_k", within("px", F.floor(F.col("_k") / side), "width").alias("px"), within("py", F.col("_k") % side, "height").alias("py"))
    shade = pixels.select("image_id", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), "r", "g", "b")
    counts = keys.join(shade, ["image_id", "px", "py"]).groupBy("id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("_first"))
    best = counts.groupBy("id").agg(F.max(F.struct((~ignored).alias("usable"), "n", (-F.col("_first")).alias("first"), "r", "g", "b")).alias("x"))
    return best.select("id", "x.r", "x.g", "x.b", "x.n")
