"""Spatial joins: blocks of polygons that meet in grid cells (``blocks``), and what is asked of their pairs.

A plain range predicate would be a nested-loop join.  Here each polygon is listed in the cells of a grid that its envelope
touches, and a pair is kept in the one cell that holds the lower left corner of its envelopes' overlap, so no ``distinct`` is
needed and no pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.operators import blocks as bl
from landspark.operators.sizes import spread
from landspark.storage import keep, new_path

#: Intersections of less area are noise.
SLIVER = 0.5


def boxes(df: DataFrame, key: str, name: str, grow: float = 0.0, **carried: Column) -> DataFrame:
    """(name, envelope columns, ``carried`` ones of geom); the envelope is grown on each side.

    They are worked out once a polygon, dealt over all tasks, and kept: sizes, cells and joins read them many times over.
    """
    out = df.select(F.col(key).alias(name), "geom").repartition(name)
    out = keep(out.select(name, g.envelope(F.col("geom")).alias("_e"), *(c.alias(k) for k, c in carried.items())), "boxes")
    return out.select(name, *carried, *((F.col(f"_e.{c}") + (grow if c[:3] == "max" else -grow)).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


def cell_size(df: DataFrame) -> float:
    """Twice the median envelope side: one number from one aggregation."""
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    return max(1.0, 2.0 * (df.agg(F.percentile_approx(side, 0.5, 1000)).first()[0] or 1.0))


def _hundredths(micro: np.ndarray) -> np.ndarray:
    """Millionths, not negative, to hundredths, half up."""
    return (micro + 5000) // 10000


def _decimals(hundredths: np.ndarray, precision: int) -> pa.Array:
    """Whole hundredths as decimals of two places."""
    return pa.Array.from_buffers(pa.decimal128(precision, 2), len(hundredths), [None, pa.py_buffer(np.stack([hundredths, hundredths >> 63], axis=1))])


def _overlaps(left: bl.Side, i: np.ndarray, area: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Areas and coverages of the left polygons, in hundredths."""
    millionths = lambda x: np.floor(x * 1e6 + 0.5).astype(np.int64)
    return _hundredths(millionths(area)), _hundredths(np.minimum(millionths(100 * area / left.boxes[i, 4]), 100_000_000))


def _types(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[str, str]:
    return left.schema[left_key].dataType.simpleString(), right.schema[right_key].dataType.simpleString()


def intersect_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, min_area: float = SLIVER, size: float | None = None, left_mark: Column | None = None, right_mark: Column | None = None) -> DataFrame:
    """Pairs of polygons that overlap by more than ``min_area``: left_id, right_id, intersection_area_m2, coverage_pct of the left, left_mark, right_mark.

    Polygons with holes and several parts need nothing special, and nothing is clipped.  Rings must be normalised and simple.
    Marks are ints that go with a polygon, for what else is asked of a pair; without them they are 0.
    """
    pairs = bl.block_pairs(bl.shapes(left, left_key, mark=left_mark, upright=False), bl.shapes(right, right_key, mark=right_mark, upright=False), size)

    def give(a: bl.Side, b: bl.Side, i: np.ndarray, j: np.ndarray, area: np.ndarray) -> pa.RecordBatch:
        some = area > min_area
        i, j, area = i[some], j[some], area[some]
        whole, share = _overlaps(a, i, area)
        return pa.RecordBatch.from_arrays([a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), _decimals(whole, 12), _decimals(share, 5), pa.array(a.marks[i]), pa.array(b.marks[j])], names=["left_id", "right_id", "intersection_area_m2", "coverage_pct", "left_mark", "right_mark"])

    one, two = _types(left, right, left_key, right_key)
    return bl.answers(pairs, bl.overlap_area, give, f"left_id {one}, right_id {two}, intersection_area_m2 decimal(12,2), coverage_pct decimal(5,2), left_mark int, right_mark int")


def best_overlaps(left: DataFrame, right: DataFrame, left_key: str, right_key: str, counts: Callable[[np.ndarray, np.ndarray], np.ndarray], min_area: float = SLIVER, size: float | None = None) -> DataFrame:
    """Of each left polygon with overlaps that count: left_id, right_id and coverage_pct of the one with the largest coverage (the least right_id of equal ones), and max_area_m2 of any.

    ``counts(area, coverage)``, in hundredths, says which overlaps count.  Pairs are folded where they are found; rows are a few a polygon.
    """
    pairs = bl.block_pairs(bl.shapes(left, left_key, upright=False), bl.shapes(right, right_key, upright=False), size)

    def give(a: bl.Side, b: bl.Side, i: np.ndarray, j: np.ndarray, area: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(area > min_area)
        whole, share = _overlaps(a, i[some], area[some])
        good = counts(whole, share)
        i, j, whole, share = i[some[good]], j[some[good]], whole[good], share[good]
        if not len(i):
            return pa.RecordBatch.from_arrays([a.ids.slice(0, 0), b.ids.slice(0, 0), _decimals(whole, 5), _decimals(whole, 12)], names=["left_id", "right_id", "coverage_pct", "max_area_m2"])
        at = bl.starts(i)
        most = np.maximum.reduceat(share, at)
        top = np.flatnonzero(share == np.repeat(most, np.diff(np.append(at, len(i)))))
        ids = b.ids.take(pa.array(j[top])).to_numpy(zero_copy_only=False)
        least = pa.array(np.minimum.reduceat(ids, bl.starts(i[top])), b.ids.type)
        return pa.RecordBatch.from_arrays([a.ids.take(pa.array(i[at])), least, _decimals(most, 5), _decimals(np.maximum.reduceat(whole, at), 12)], names=["left_id", "right_id", "coverage_pct", "max_area_m2"])

    one, two = _types(left, right, left_key, right_key)
    rows = bl.answers(pairs, bl.overlap_area, give, f"left_id {one}, right_id {two}, coverage_pct decimal(5,2), max_area_m2 decimal(12,2)")
    # of whole decimals, so that the largest coverage and the least id are one least struct
    best = rows.groupBy("left_id").agg(F.min(F.struct((-F.col("coverage_pct")).alias("c"), "right_id")).alias("_b"), F.max("max_area_m2").alias("max_area_m2"))
    return best.select("left_id", "_b.right_id", (-F.col("_b.c")).cast("decimal(5,2)").alias("coverage_pct"), "max_area_m2")


def dwithin_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, d: float, size: float | None = None) -> DataFrame:
    """Pairs of polygons at most ``d`` apart: left_id, right_id, distance_m (0 if they overlap or one holds the other)."""
    pairs = bl.block_pairs(bl.shapes(left, left_key, grow=d), bl.shapes(right, right_key), size)

    def give(a: bl.Side, b: bl.Side, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        near = np.flatnonzero(distance <= d)
        return pa.RecordBatch.from_arrays([a.ids.take(pa.array(i[near])), b.ids.take(pa.array(j[near])), pa.array(distance[near])], names=["left_id", "right_id", "distance_m"])

    one, two = _types(left, right, left_key, right_key)
    return bl.answers(pairs, bl.distance, give, f"left_id {one}, right_id {two}, distance_m double")


def least_distances(left: DataFrame, right: DataFrame, left_key: str, right_key: str, d: float, kinds: dict[str, Column], size: float | None = None) -> DataFrame:
    """Of each left polygon with a right one of any kind at most ``d`` apart: left_id and the least distance to each kind, null beyond ``d``.

    ``kinds`` are tests of the right rows by the name of their column.  Pairs are folded where they are found; rows are a few a polygon.
    """
    bits = sum((F.when(test, F.lit(1 << k)).otherwise(0) for k, test in enumerate(kinds.values())), F.lit(0))
    pairs = bl.block_pairs(bl.shapes(left, left_key, grow=d), bl.shapes(right, right_key, mark=bits), size)
    names = list(kinds)

    def give(a: bl.Side, b: bl.Side, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        at, mark = bl.starts(i), b.marks[j]
        least = [np.minimum.reduceat(np.where((mark >> k & 1 == 1) & (distance <= d), distance, np.inf), at) for k in range(len(names))]
        some = np.flatnonzero(np.minimum.reduce(least) < np.inf)
        return pa.RecordBatch.from_arrays([a.ids.take(pa.array(i[at[some]])), *(pa.array(v[some], mask=v[some] == np.inf) for v in least)], names=["left_id", *names])

    rows = bl.answers(pairs, bl.distance, give, f"left_id {left.schema[left_key].dataType.simpleString()}, " + ", ".join(f"{k} double" for k in names), lambda _, mark: mark > 0)
    return rows.groupBy("left_id").agg(*(F.min(k).alias(k) for k in names))


def spacing(left: DataFrame, right: DataFrame) -> float:
    """The side of a square of the area that both sides cover, for one row of the right side: about how far its rows are apart."""
    e = g.envelope(F.col("geom"))
    row = right.select(e.alias("e")).unionByName(left.select(e.alias("e"))).agg(F.min("e.minx"), F.min("e.miny"), F.max("e.maxx"), F.max("e.maxy")).first()
    if row[0] is None:
        return 1.0
    return max(1.0, ((row[2] - row[0]) * (row[3] - row[1]) / max(1, right.count())) ** 0.5)


def _held(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_id, distance_m = 0) of left polygons whose first vertex lies in a right one; points meet boxes in cells of the box's level."""
    around = boxes(right, right_key, "right_id", _r=g.edges(F.col("geom")))
    size = cell_size(around) / 2
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(size))
    around = around.withColumn("level", F.ceil(F.log2(side / size)).cast("int"))
    top = around.agg(F.max("level")).first()[0] or 0
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step)))
    celled = around.withColumn("cx", cells("minx", "maxx")).withColumn("cy", cells("miny", "maxy")).alias("b")
    first = F.get(F.get(F.get(F.col("geom"), F.lit(0)), F.lit(0)), F.lit(0))
    spots = left.select(F.col(left_key).alias("left_id"), first.alias("_p")).select("left_id", "_p.x", "_p.y", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    spots = spots.withColumn("cx", F.floor(F.col("x") / step)).withColumn("cy", F.floor(F.col("y") / step)).alias("a")
    on = (F.col("a.level") == F.col("b.level")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    near = F.col("a.x").between(F.col("b.minx"), F.col("b.maxx")) & F.col("a.y").between(F.col("b.miny"), F.col("b.maxy"))
    held = spots.join(celled, on & near & g.edges_hold(F.col("b._r"), F.col("a.x"), F.col("a.y")), "left_semi")
    return held.select("left_id").distinct().select("left_id", F.lit(0.0).alias("distance_m"))


def nearest_distance(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius: float | None = None, max_radius: float | None = None) -> DataFrame:
    """(left_id, distance_m to the nearest right polygon) by searches of growing radius for the rows not yet served.

    The first radius, unless it is given, is about how far the right rows are apart, so that one search serves nearly all;
    each further one is three times as wide.  ``max_radius`` ends the search; without it, it goes on until every left row
    has found one, and an empty right side ends it at once.  Before, rows whose first vertex lies in a right polygon are served
    by a semi join, which stops at the first such polygon however many lie there.  Rows without a find have no row.  What a search leaves is
    written to the shared folder, so no search is done twice.
    """
    spark, none = left.sparkSession, "left_id long, distance_m double"
    if right.isEmpty():
        return spark.createDataFrame([], none)
    radius = spacing(left, right) if radius is None else radius
    found = keep(_held(left, right, left_key, right_key), "held")
    rest = left.select(left_key, "geom").join(found, F.col(left_key) == F.col("left_id"), "left_anti")
    if rest.isEmpty():
        return found
    while True:
        radius = radius if max_radius is None else min(radius, max_radius)
        path = new_path(spark, "nearest")
        least_distances(rest, right, left_key, right_key, radius, {"distance_m": F.lit(True)}).write.parquet(path)
        part = spark.read.parquet(path)
        found = found.unionByName(part)
        rest = rest.join(part, rest[left_key] == part["left_id"], "left_anti")
        if max_radius is not None and radius >= max_radius or rest.isEmpty():
            return found
        radius *= 3


def shared_boundary(left: DataFrame, right: DataFrame, left_key: str, right_key: str, within: float = 5.0, tolerance: float = 1e-9) -> DataFrame:
    """Of each left polygon with a right one within ``within``: shared_boundary_m, summed, and adjacent_pct, the largest share of its perimeter.

    Metres count once for each right polygon, so overlapping ones count twice.
    """
    pairs = bl.block_pairs(bl.shapes(left, left_key, grow=within), bl.shapes(right, right_key))

    def give(a: bl.Side, b: bl.Side, i: np.ndarray, j: np.ndarray, metres: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
        at = bl.starts(i)
        of = lambda fold, v: pa.array(fold.reduceat(v, at))
        return pa.RecordBatch.from_arrays([a.ids.take(pa.array(i[at])), of(np.add, metres), of(np.maximum, metres), of(np.logical_or, (metres > 0) | inside)], names=["left_id", "s", "top", "sure"])

    each = bl.answers(pairs, bl.shared_metres(tolerance), give, f"left_id {left.schema[left_key].dataType.simpleString()}, s double, top double, sure boolean")
    # a polygon that shares metres, or starts in the other, is within any distance; of others the distance decides, and they share nothing
    sums = keep(each.groupBy("left_id").agg(F.sum("s").alias("s"), F.max("top").alias("top"), F.bool_or("sure").alias("sure")), "shared")
    unsure = left.join(sums.filter("NOT sure"), F.col(left_key) == F.col("left_id"), "left_semi")
    near = least_distances(unsure, right, left_key, right_key, within, {"distance_m": F.lit(True)})
    found = sums.filter("sure").select("left_id", "s", "top").union(near.select("left_id", F.lit(0.0), F.lit(0.0)))
    around = left.select(F.col(left_key).alias("left_id"), g.perimeter(F.col("geom")).alias("_around"))
    return found.join(around, "left_id").select("left_id", F.round("s", 2).alias("shared_boundary_m"), F.round(100 * F.col("top") / F.col("_around"), 2).alias("adjacent_pct"))


#: Children of a block of ranks in ``count_in_boxes``.
FAN = 4


def _running(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``n``, the points (kind 1) of the group so far; a low end (kind 0) comes before the points that equal it, a high end (kind 2) behind them."""
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("n", F.count_if(F.col("kind") == 1).over(so_far))


def count_in_boxes(points: DataFrame, boxes: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(group, keys, n): how many points (group, x, y) lie in each box (group, keys, minx, miny, maxx, maxy) of their group, borders included.

    No point meets a box.  A box's sides become ranks among the x of its group's points, and the ranks between them a few blocks of
    4, 16, 64 ... ranks; points of a block are counted up to the box's two ends in y by one running count, so work grows with
    (points + boxes) times the logarithm of a group's points, wherever they lie.
    """
    low, high = F.lit(0).alias("kind"), F.lit(2).alias("kind")
    # a box is named by its row in what follows, so that its keys are carried as one column
    boxes = boxes.filter(F.col(group).isNotNull() & (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))).select(group, F.struct(*keys).alias("box"), "minx", "miny", "maxx", "maxy")
    points = points.filter(F.col(group).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(group, F.lit(None).cast(boxes.schema["box"].dataType).alias("box"), F.lit(1).alias("kind"), "x", "y", F.lit(None).cast("double").alias("y2"))
    ends = [boxes.select(group, "box", kind, F.col(x).alias("x"), F.col("miny").alias("y"), F.col("maxy").alias("y2")) for kind, x in ((low, "minx"), (high, "maxx"))]
    ranked = keep(_running(points.unionByName(ends[0]).unionByName(ends[1]), [group], ["x", "kind", "y"]), "ranks")
    most = ranked.agg(F.max("n")).first()[0] or 0  # one number
    levels = next(k for k in range(1, 64) if FAN**k >= most)
    size = lambda k: F.lit(FAN**k).cast("long")
    spots = ranked.filter("kind = 1").select(group, "box", "kind", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor((F.col("n") - 1) / size(k)).alias("block")) for k in range(levels)))).alias("_b"))
    # ranks from a (points before the box) to b (points before its end), not included
    spans = ranked.filter("kind <> 1").groupBy(group, "box", "y", "y2").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("a"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("b")).filter("a < b")
    first, end = (lambda k: F.ceil(F.col("a") / size(k))), (lambda k: F.floor(F.col("b") / size(k)))
    none = F.array().cast("array<bigint>")
    some = lambda i, j: F.when(i < j, F.sequence(i, j - 1)).otherwise(none)

    def whole(k: int) -> Column:
        """Blocks of level ``k`` between a and b that no larger block between them holds."""
        i, j, up, down = first(k), end(k), first(k + 1) * FAN, end(k + 1) * FAN
        found = F.when(up < down, F.concat(some(i, up), some(down, j))).otherwise(some(i, j))
        return F.transform(found, lambda x: F.struct(F.lit(k).alias("level"), x.alias("block")))

    sides = F.explode(F.array(F.struct(low, F.col("y").alias("y")), F.struct(high, F.col("y2").alias("y")))).alias("_s")
    asked = spans.select(group, "box", "y", "y2", F.explode(F.flatten(F.array(*map(whole, range(levels))))).alias("_b")).select(group, "box", "_b", sides).select(group, "box", "_s.kind", "_s.y", "_b")
    rows = spots.unionByName(asked).select(group, "box", "kind", "y", "_b.level", "_b.block")
    counted = _running(rows, [group, "level", "block"], ["y", "kind"]).filter("kind <> 1")
    return counted.groupBy(group, "box").agg(F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(-F.col("n"))).alias("n")).select(group, "box.*", "n")


def match_plan_extents(parcels: DataFrame, plans: DataFrame) -> DataFrame:
    """Parcels whose interior point lies in a plan's box of the same commune, and in the box with its axes swapped.

    Per plan: teryt_gmina, zone_id, n_hits, n_swapped_hits and bbox_axes_suspect (hits only when swapped).  Hits are counted
    (``count_in_boxes``), not joined, for they are as many as parcels times plans of a commune; plans of communes without parcels
    have no row.
    """
    # kept, for a filter on a point would be moved below the steps that make it and hold all of them, each many times over
    points = keep(g.with_display_point(spread(parcels.select("teryt_gmina", "geom")), name="_p").select("teryt_gmina", "_p.x", "_p.y"), "points")
    extents = keep(plans.select("teryt_gmina", "zone_id", g.envelope(F.col("geom")).alias("_b")).select("teryt_gmina", "zone_id", "_b.*"), "extents")
    # one box for each different extent of a plan's rows; a point with its axes swapped lies in a box when it lies in the swapped box
    named = extents.groupBy(*extents.columns).agg(F.count(F.lit(1)).alias("times"))
    as_is, turned = ("minx", "miny", "maxx", "maxy"), ("miny", "minx", "maxy", "maxx")
    asked = [named.select("teryt_gmina", "zone_id", "times", F.struct(*as_is).alias("extent"), F.lit(swapped).alias("swapped"), *(F.col(c).alias(d) for c, d in zip(sides, as_is, strict=True))) for swapped, sides in ((False, as_is), (True, turned))]
    counts = count_in_boxes(points, asked[0].unionByName(asked[1]), "teryt_gmina", ["zone_id", "times", "extent", "swapped"])
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n") * F.col("times"))), F.lit(0).cast("long"))
    hits = counts.groupBy("teryt_gmina", "zone_id").agg(of(~F.col("swapped")).alias("n_hits"), of(F.col("swapped")).alias("n_swapped_hits"))
    known = extents.select("teryt_gmina", "zone_id").join(parcels.select("teryt_gmina").distinct(), "teryt_gmina", "left_semi")
    out = known.join(hits, ["teryt_gmina", "zone_id"], "left").fillna(0, ["n_hits", "n_swapped_hits"])
    return out.withColumn("bbox_axes_suspect", (F.col("n_hits") == 0) & (F.col("n_swapped_hits") > 0))


def bbox_tiles(df: DataFrame, size: float = 10_000.0) -> DataFrame:
    """Tiles of a table of boxes (minx, miny, maxx, maxy): the last of each row and column is clipped."""
    steps = lambda low, high: F.sequence(F.lit(0), F.greatest(F.ceil((F.col(high) - F.col(low)) / size) - 1, F.lit(0)).cast("int"))
    out = df.withColumn("tx", F.explode(steps("minx", "maxx"))).withColumn("ty", F.explode(steps("miny", "maxy")))
    low = lambda c, t: F.col(c) + F.col(t) * size
    return out.select("tx", "ty", low("minx", "tx").alias("tile_minx"), low("miny", "ty").alias("tile_miny"), F.least(F.col("maxx"), low("minx", "tx") + size).alias("tile_maxx"), F.least(F.col("maxy"), low("miny", "ty") + size).alias("tile_maxy"))
