"""Measures of polygon columns as expressions.

A geometry is ``array<array<array<struct<x:double,y:double>>>>``: polygons, rings (the outer first) and vertices; outer
rings run clockwise, holes counter-clockwise, and rings are not closed.  Everything here is higher-order functions, so it
stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, of) -> Column:
    """``of(value)``, with the value worked out once however often ``of`` names it; inside lambdas Spark would repeat it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def closed_edges(ring: Column) -> Column:
    """The directed edges of a ring as structs (x1, y1, x2, y2)."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def edges(geom: Column) -> Column:
    """All directed edges of a geometry."""
    return F.flatten(F.transform(F.flatten(geom), closed_edges))


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom))


def total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, e: a + of(e))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring: positive if it runs clockwise."""
    return total(closed_edges(ring), lambda e: (e["x2"] - e["x1"]) * (e["y1"] + e["y2"]) / 2)


def area(geom: Column) -> Column:
    """Area with holes, of rings that are normalised."""
    return total(edges(geom), lambda e: (e["x2"] - e["x1"]) * (e["y1"] + e["y2"]) / 2)


def perimeter(geom: Column) -> Column:
    return total(edges(geom), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def envelope(geom: Column) -> Column:
    along = lambda v: F.struct(F.transform(v, lambda p: p["x"]).alias("x"), F.transform(v, lambda p: p["y"]).alias("y"))
    bounds = lambda c: F.struct(F.array_min(c["x"]).alias("minx"), F.array_min(c["y"]).alias("miny"), F.array_max(c["x"]).alias("maxx"), F.array_max(c["y"]).alias("maxy"))
    return let(let(vertices(geom), along), bounds)


def centroid(geom: Column) -> Column:
    """Area centroid as a struct (x, y); null for an area of zero."""

    def of(p: Column, lines: Column) -> Column:
        """From one fold over the edges: area and first moments about the first vertex, which lies near, for precision's sake."""

        def add(t: Column, e: Column) -> Column:
            cross = (e["x2"] - p["x"]) * (e["y1"] - p["y"]) - (e["x1"] - p["x"]) * (e["y2"] - p["y"])
            moment = lambda axis: (e[f"{axis}1"] - p[axis] + e[f"{axis}2"] - p[axis]) * cross / 6
            return F.struct((t["a"] + (e["x2"] - e["x1"]) * (e["y1"] - p["y"] + e["y2"] - p["y"]) / 2).alias("a"), (t["x"] + moment("x")).alias("x"), (t["y"] + moment("y")).alias("y"))

        sums = F.aggregate(lines, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), add)
        return let(sums, lambda t: F.when(t["a"] != 0, F.struct((p["x"] + t["x"] / t["a"]).alias("x"), (p["y"] + t["y"] / t["a"]).alias("y"))))

    return let(F.struct(F.get(vertices(geom), F.lit(0)).alias("p"), edges(geom).alias("e")), lambda v: of(v["p"], v["e"]))


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings, holes included."""
    return edges_hold(edges(geom), x, y)


def edges_hold(lines: Column, x: Column, y: Column) -> Column:
    """``contains_point`` for a polygon given by its edges."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(lines, crosses)) % 2 == 1


def swap_xy(geom: Column) -> Column:
    return F.transform(geom, lambda g: F.transform(g, lambda r: F.transform(r, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))))


def normalise_rings(geom: Column) -> Column:
    """Outer rings clockwise and holes counter-clockwise, closing vertices dropped, polygons with an outer ring below three vertices left out."""
    open_ring = lambda r: F.when((F.size(r) > 1) & (r[0] == F.element_at(r, -1)), F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r)
    turned = lambda r, i: F.when((ring_area(r) < 0) != (i > 0), F.reverse(r)).otherwise(r)
    return F.filter(F.transform(geom, lambda g: F.transform(F.transform(g, open_ring), turned)), lambda g: (F.size(g) > 0) & (F.size(g[0]) >= 3))


def geom_hash(geom: Column) -> Column:
    """The centroid in whole metres, as the spatial part of a zone's natural key."""
    c = centroid(geom)
    return F.concat_ws("_", F.rint(c["x"]).cast("long").cast("string"), F.rint(c["y"]).cast("long").cast("string"))


def with_display_point(df: DataFrame, geom_col: str = "geom", name: str = "display_point") -> DataFrame:
    """``df`` with a point inside the largest polygon: its centroid, else its envelope's centre, else the inner grid point
    nearest to the centroid, else its first vertex.

    The steps are columns of their own, so that no expression holds another many times over; the grid is tried only where
    neither the centroid nor the centre is inside.
    """
    by_size = lambda geom: F.array_sort(F.transform(geom, lambda a: F.struct((-F.abs(area(F.array(a)))).alias("k"), a.alias("a"))))
    one = F.when(F.size(geom_col) == 1, F.get(F.col(geom_col), F.lit(0))).otherwise(F.element_at(by_size(F.col(geom_col)), 1)["a"])
    out = df.withColumn("_one", F.array(one)).withColumn("_e", edges(F.col("_one")))
    out = out.withColumn("_c", centroid(F.col("_one"))).withColumn("_b", envelope(F.col("_one")))
    mid = lambda axis: (F.col(f"_b.min{axis}") + F.col(f"_b.max{axis}")) / 2
    step = lambda axis, i: F.col(f"_b.min{axis}") + (F.col(f"_b.max{axis}") - F.col(f"_b.min{axis}")) * i / 6
    steps = F.sequence(F.lit(1), F.lit(5))
    grid = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct(step("x", i).alias("x"), step("y", j).alias("y")))))
    near = lambda p: F.struct(F.hypot(p["x"] - F.col("_c.x"), p["y"] - F.col("_c.y")).alias("d"), p.alias("p"))
    inner = F.array_min(F.transform(F.filter(grid, lambda p: edges_hold(F.col("_e"), p["x"], p["y"])), near))["p"]
    inside = lambda c: edges_hold(F.col("_e"), F.col(f"{c}.x"), F.col(f"{c}.y"))
    out = out.withColumn("_m", F.struct(mid("x").alias("x"), mid("y").alias("y")))
    point = F.when(inside("_c"), F.col("_c")).when(inside("_m"), F.col("_m")).otherwise(F.coalesce(inner, F.col("_one")[0][0][0]))
    return out.withColumn(name, point).drop("_one", "_e", "_c", "_b", "_m")


# fixed values: the GRS80 ellipsoid and the projection of EPSG:2180
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
MERIDIAN, SCALE, FALSE_EAST, FALSE_NORTH = 19.0, 0.9993, 500000.0, -5300000.0
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Coefficients of the series in the third flattening, to its fourth power, forward and inverse.
FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
INVERSE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_ECC = 2 * _N**0.5 / (1 + _N)


def to_2180(lon: Column, lat: Column) -> Column:
    """WGS84 degrees to metres, as a struct (x, y)."""
    s, dl = F.sin(F.radians(lat)), F.radians(lon - MERIDIAN)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(FORWARD, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((FALSE_EAST + SCALE * _RECTIFYING * x).alias("x"), (FALSE_NORTH + SCALE * _RECTIFYING * y).alias("y"))


def to_4326(x: Column, y: Column) -> Column:
    """Metres to WGS84 degrees, as a struct (x: longitude, y: latitude).

    What a step needs more than once is bound: angles, then the conformal latitude.
    """

    def unrolled(p: Column) -> Column:
        u, v = p["xi"], p["eta"]
        for k, b in enumerate(INVERSE, 1):
            u = u - b * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"])
            v = v - b * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"])
        return let(F.struct(u.alias("u"), v.alias("v")), conformal)

    def conformal(q: Column) -> Column:
        return let(F.struct(F.asin(F.sin(q["u"]) / F.cosh(q["v"])).alias("c"), F.atan2(F.sinh(q["v"]), F.cos(q["u"])).alias("l")), geodetic)

    def geodetic(r: Column) -> Column:
        lat, own = r["c"], F.atanh(F.sin(r["c"]))
        for _ in range(6):  # the latitude whose conformal latitude this is, by fixed-point steps
            lat = F.asin(F.tanh(own + _ECC * F.atanh(_ECC * F.sin(lat))))
        return F.struct((MERIDIAN + F.degrees(r["l"])).alias("x"), F.degrees(lat).alias("y"))

    return let(F.struct(((y - FALSE_NORTH) / (SCALE * _RECTIFYING)).alias("xi"), ((x - FALSE_EAST) / (SCALE * _RECTIFYING)).alias("eta")), unrolled)
