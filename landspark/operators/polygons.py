"""Checks of landed polygons, and the quarantine of those that fail one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.storage import keep

#: Reasons, in the order in which they are named.
OPEN, SHORT, FLAT, CROSSING, EMPTY = "open_ring", "short_ring", "zero_area", "self_crossing", "no_ring"
#: Square metres up to which an area is none.
NOTHING = 1e-9
#: Edges up to which a ring's edges are tried in its own row.
FEW = 32


def _rings(df: DataFrame, key: str, geom: str) -> DataFrame:
    """(key, part, ring, v) of every ring as it landed."""
    parts = df.select(key, F.posexplode(geom).alias("part", "_p"))
    return parts.select(key, "part", F.posexplode("_p").alias("ring", "v"))


def _side(p: Column, q: Column, x: Column, y: Column) -> Column:
    """The side of the line from p to q on which a point lies: -1, 0 or 1."""
    return F.signum((q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]))


def _edges_of(v: Column) -> Column:
    """The edges (i, p, q) of a landed ring, without its closing vertex and repeated ones; null if fewer than three are left."""
    same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    bare = F.when((F.size(v) > 1) & same(F.get(v, F.lit(0)), F.element_at(v, -1)), F.slice(v, F.lit(1), F.size(v) - 1)).otherwise(v)
    single = lambda r: F.filter(r, lambda x, i: (i == 0) | ~same(x, F.get(r, i - 1)))
    lines = lambda r: F.when(F.size(r) > 2, F.transform(r, lambda x, i: F.struct(i.alias("i"), x.alias("p"), F.get(r, (i + 1) % F.size(r)).alias("q"))))
    return g.let(g.let(bare, single), lines)


def _wrong(e: Column, f: Column, n: Column) -> Column:
    """Whether two edges (i, p, q) of a ring of n, the second one later in it, meet elsewhere than neighbours do at their vertex."""
    one, two, three, four = e["p"], e["q"], f["p"], f["q"]
    within = lambda k: F.greatest(F.least(one[k], two[k]), F.least(three[k], four[k])) <= F.least(F.greatest(one[k], two[k]), F.greatest(three[k], four[k]))
    split = lambda a, b, c, d: _side(a, b, c["x"], c["y"]) * _side(a, b, d["x"], d["y"]) <= 0
    meet = within("x") & within("y") & split(one, two, three, four) & split(three, four, one, two)
    follows, closes = f["i"] == e["i"] + 1, (e["i"] == 0) & (f["i"] == n - 1)
    # neighbours share a vertex; they are wrong only if one runs back along the other
    back = lambda a, b, c: (_side(a, b, c["x"], c["y"]) == 0) & ((a["x"] - b["x"]) * (c["x"] - b["x"]) + (a["y"] - b["y"]) * (c["y"] - b["y"]) > 0)
    return F.when(follows & closes, F.lit(True)).when(follows, back(one, two, four)).when(closes, back(two, one, three)).otherwise(meet)


def crossing_rings(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """(key, part, ring) of rings of which two edges cross, touch or lie on each other, but for neighbours that share their vertex.

    Pairs of edges of a ring of at most ``FEW`` edges are tried within its row.  Edges of the others meet in the cells of a grid as wide
    as the ring's edges are on average, each only in the cells that it passes through, so a ring of n edges has about as many cells and
    is spread over tasks; it is never joined with itself as a whole.
    """
    rows = _rings(df, key, geom).filter(F.size("v") > 1)
    tried = lambda e: F.when(F.size(e) <= FEW, F.exists(e, lambda x: F.exists(e, lambda y: (x["i"] < y["i"]) & _wrong(x, y, F.size(e)))))
    few = rows.filter(g.let(_edges_of(F.col("v")), tried)).select(key, "part", "ring")
    width = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + F.hypot(x["q"]["x"] - x["p"]["x"], x["q"]["y"] - x["p"]["y"])) / F.size(e)
    measured = lambda e: g.let(width(e), lambda w: F.transform(e, lambda x: F.struct(F.size(e).alias("n"), w.alias("w"), x["i"].alias("i"), x["p"].alias("p"), x["q"].alias("q"))))
    # a ring of so many edges has so many vertices; both sides of the join read the kept edges
    many = rows.filter(F.size("v") > FEW).select(key, "part", "ring", F.explode(g.let(_edges_of(F.col("v")), lambda e: F.when(F.size(e) > FEW, measured(e)))).alias("e"))
    edges = keep(many.select(key, "part", "ring", "e.*"), "edges")
    low, high = (lambda c, f=f: f(F.col(f"p.{c}"), F.col(f"q.{c}")) for f in (F.least, F.greatest))
    cell = lambda x: F.floor(x / F.col("w"))
    edges = edges.withColumn("cx", F.explode(F.sequence(cell(low("x")), cell(high("x")))))
    # the part of the edge inside a column of cells
    at = lambda x: F.when(F.col("q.x") == F.col("p.x"), F.col("p.y")).otherwise(F.col("p.y") + (F.col("q.y") - F.col("p.y")) * (x - F.col("p.x")) / (F.col("q.x") - F.col("p.x")))
    a, b = at(F.greatest(low("x"), F.col("cx") * F.col("w"))), at(F.least(high("x"), (F.col("cx") + 1) * F.col("w")))
    upright = F.col("q.x") == F.col("p.x")
    bottom, top = F.when(upright, low("y")).otherwise(F.least(a, b)), F.when(upright, high("y")).otherwise(F.greatest(a, b))
    # rounding at a cell's border must not part two edges that touch there
    edges = edges.withColumn("cy", F.explode(F.sequence(F.floor(bottom / F.col("w") - 1e-9), F.floor(top / F.col("w") + 1e-9)))).drop("w")
    x, y = edges.alias("x"), edges.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (key, "part", "ring", "cx", "cy")]
    pairs = x.join(y, [*on, F.col("x.i") < F.col("y.i")])
    edge = lambda t: {c: F.col(f"{t}.{c}") for c in ("i", "p", "q")}
    met = pairs.filter(_wrong(edge("x"), edge("y"), F.col("x.n")))
    return few.union(met.select(F.col(f"x.{key}"), F.col("x.part"), F.col("x.ring")).distinct())


def polygon_faults(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """(key, reasons) of polygons with a fault: the sorted reasons of all their rings.

    Rings are to be closed (the last vertex is the first one), with three different vertices at least, an area, and no two edges that
    meet elsewhere than at their common vertex.  A null or empty geometry, or part, has no ring.  ``key`` is unique.
    """
    same = (F.get("v", F.lit(0))["x"] == F.element_at("v", -1)["x"]) & (F.get("v", F.lit(0))["y"] == F.element_at("v", -1)["y"])
    few = F.size(F.array_distinct("v")) < 3
    plain = F.array_compact(F.array(F.when(F.size("v") == 0, EMPTY), F.when((F.size("v") > 0) & ~same, OPEN), F.when((F.size("v") > 0) & few, SHORT), F.when(~few & (F.abs(g.ring_area(F.col("v"))) <= NOTHING), FLAT)))
    simple = _rings(df, key, geom).select(key, F.explode(plain).alias("reason"))
    crossing = crossing_rings(df, key, geom).select(key, F.lit(CROSSING).alias("reason"))
    none = df.filter(F.coalesce(F.size(geom), F.lit(0)) <= 0).select(key, F.lit(EMPTY).alias("reason"))
    hollow = df.filter(F.exists(geom, lambda part: F.size(part) <= 0)).select(key, F.lit(EMPTY).alias("reason"))
    return simple.union(crossing).union(none).union(hollow).groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))  # at most the five reasons


def quarantine(df: DataFrame, key: str, geom: str = "geom") -> tuple[DataFrame, DataFrame]:
    """Rows whose polygon has no fault, and the others with their reasons."""
    faults = polygon_faults(df, key, geom)
    return df.join(faults, key, "left_anti"), df.join(faults, key)
