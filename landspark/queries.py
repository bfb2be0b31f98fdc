"""Registered queries of the land operators, over tables derived from the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landspark.fixtures import derived, duck, duck_edges
from landspark.functions import geometry as g
from landspark.functions import planning as p
from landspark.operators import spatial
from landspark.operators.sizes import spread
from landspark.plans import delta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir) under a name, with its oracle."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


# ---- geometry measures ----

AREA = "sum((x2 - x1) * (y1 + y2) / 2)"
MEASURES = f"""
WITH {duck('fx_zones')}, {duck_edges('e', 'fx_zones', 'zone_id')}
SELECT zone_id, round({AREA}, 4) AS area_m2, round(sum(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1))), 4) AS perimeter_m,
  min(x1) AS minx, max(y1) AS maxy,
  round(min(x1) + sum(((x1-500000)+(x2-500000)) * ((x2-500000)*(y1-300000) - (x1-500000)*(y2-300000)) / 6) / {AREA} + 500000 - min(x1), 3) AS cx,
  round(sum(((y1-300000)+(y2-300000)) * ((x2-500000)*(y1-300000) - (x1-500000)*(y2-300000)) / 6) / {AREA} + 300000, 3) AS cy
FROM e GROUP BY zone_id
"""


@query("b_measures", MEASURES)
def b_measures(spark, sf_dir):
    """Area, perimeter, envelope and centroid of every zone."""
    geom = F.col("geom")
    box, c = g.envelope(geom), g.centroid(geom)
    return derived(spark, sf_dir, "fx_zones").select("zone_id", F.round(g.area(geom), 4).alias("area_m2"), F.round(g.perimeter(geom), 4).alias("perimeter_m"), box["minx"].alias("minx"), box["maxy"].alias("maxy"), F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"))


@query(
    "b_collection_bounds",
    f"WITH {duck('fx_zones')}, {duck_edges('e', 'fx_zones', 'zone_id')} SELECT plan_type, min(x1) AS minx, min(y1) AS miny, max(x1) AS maxx, max(y1) AS maxy, count(DISTINCT zone_id) AS n FROM e JOIN fx_zones USING (zone_id) GROUP BY plan_type",
)
def b_collection_bounds(spark, sf_dir):
    """Bounds of whole collections."""
    boxes = derived(spark, sf_dir, "fx_zones").select("plan_type", g.envelope(F.col("geom")).alias("b"))
    return boxes.groupBy("plan_type").agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"), F.count(F.lit(1)).alias("n"))


@query(
    "b_swap_and_sliver",
    f"WITH {duck('fx_parcels')}, {duck_edges('e', 'fx_parcels', 'parcel_id')} SELECT parcel_id, min(y1) AS swapped_minx, round(sum((y2 - y1) * (x1 + x2) / 2), 4) AS swapped_area FROM e GROUP BY parcel_id HAVING {AREA} >= 500 AND min(x1) BETWEEN 140000 AND 900000 AND min(y1) BETWEEN 100000 AND 800000",
)
def b_swap_and_sliver(spark, sf_dir):
    """Axis swap, country bounds and the least-area rule."""
    geom = F.col("geom")
    box = g.envelope(geom)
    kept = derived(spark, sf_dir, "fx_parcels").filter((g.area(geom) >= 500) & box["minx"].between(140_000, 900_000) & box["miny"].between(100_000, 800_000))
    return kept.select("parcel_id", g.envelope(g.swap_xy(geom))["minx"].alias("swapped_minx"), F.round(g.area(g.swap_xy(geom)), 4).alias("swapped_area"))


@query("b_geom_hash")
def b_geom_hash(spark, sf_dir):
    """Spatial natural key and an interior display point of every zone (B9, B10, B14); held against brute force in the tests."""
    geom, point = F.col("geom"), F.col("display_point")
    return g.with_display_point(spread(derived(spark, sf_dir, "fx_zones"))).select("zone_id", g.geom_hash(geom).alias("geom_hash"), point["x"].alias("px"), point["y"].alias("py"), g.contains_point(geom, point["x"], point["y"]).alias("inside"))


@query("b_reproject")
def b_reproject(spark, sf_dir):
    """Zone corners to WGS84 and back (B12); the tests check the round trip and known points."""
    corner = F.col("geom")[0][0][0]
    geo = derived(spark, sf_dir, "fx_zones").select("zone_id", corner.alias("c"), g.to_4326(corner["x"], corner["y"]).alias("w"))
    back = g.to_2180(F.col("w.x"), F.col("w.y"))
    return geo.select("zone_id", F.round("w.x", 7).alias("lon"), F.round("w.y", 7).alias("lat"), F.round(F.hypot(back["x"] - F.col("c.x"), back["y"] - F.col("c.y")), 3).alias("error_m"))


@query(
    "b_tiles",
    """
WITH b AS (SELECT zone_id, 100.0 * (100 + zone_id % 400) AS w, 90.0 * (100 + zone_id % 300) AS h FROM (SELECT c_custkey AS zone_id FROM customer)),
t AS (SELECT zone_id, w, h, unnest(range(0, greatest(ceil(w / 10000)::INT, 1))) AS tx FROM b),
u AS (SELECT zone_id, w, h, tx, unnest(range(0, greatest(ceil(h / 10000)::INT, 1))) AS ty FROM t)
SELECT tx::INT AS tx, ty::INT AS ty, count(*) AS n, round(sum((least(w, tx * 10000 + 10000) - tx * 10000) * (least(h, ty * 10000 + 10000) - ty * 10000)), 2) AS area FROM u GROUP BY tx, ty
""",
)
def b_tiles(spark, sf_dir):
    """Tiles of many boxes, the last of each row and column clipped."""
    zones = spark.read.parquet(f"{sf_dir}/customer.parquet")
    boxes = zones.select(F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"), (100.0 * (100 + F.col("c_custkey") % 400)).alias("maxx"), (90.0 * (100 + F.col("c_custkey") % 300)).alias("maxy"))
    tiles = spatial.bbox_tiles(boxes)
    area = (F.col("tile_maxx") - F.col("tile_minx")) * (F.col("tile_maxy") - F.col("tile_miny"))
    return tiles.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(area), 2).alias("area"))


# ---- spatial joins and the delta plan ----

CROSSING = """greatest(least(p.x1, p.x2), least(q.x1, q.x2)) AS a, least(greatest(p.x1, p.x2), greatest(q.x1, q.x2)) AS b"""


def duck_overlaps(left: str, right: str, left_key: str, right_key: str) -> str:
    """CTEs ending in ``ov`` (left key, right key, area): the edge formula over all pairs with overlapping envelopes."""
    return f"""{duck_edges('le', left, left_key)}, {duck_edges('re', right, right_key)},
cand AS (SELECT l.{left_key}, r.{right_key}, least(l.x0, r.x0) AS ox, least(l.y0, r.y0) AS oy FROM {left} l JOIN {right} r
  ON l.x0 <= r.x0 + r.w AND r.x0 <= l.x0 + l.w AND l.y0 <= r.y0 + r.h AND r.y0 <= l.y0 + l.h),
ep AS (SELECT c.{left_key}, c.{right_key}, sign(p.x2 - p.x1) * sign(q.x2 - q.x1) AS s, {CROSSING},
  p.x1 AS px, p.y1 - oy AS py, (p.y2 - p.y1) / nullif(p.x2 - p.x1, 0) AS pm, q.x1 AS qx, q.y1 - oy AS qy, (q.y2 - q.y1) / nullif(q.x2 - q.x1, 0) AS qm
  FROM cand c JOIN le p USING ({left_key}) JOIN re q USING ({right_key})),
ev AS (SELECT *, py + pm * (a - px) AS pa, py + pm * (b - px) AS pb, qy + qm * (a - qx) AS qa, qy + qm * (b - qx) AS qb FROM ep WHERE a < b),
ei AS (SELECT *, CASE WHEN (pa - qa) * (pb - qb) < 0 THEN (pa - qa) / ((pa - qa) - (pb - qb)) END AS t FROM ev),
ov AS (SELECT {left_key}, {right_key}, round(sum(s * (b - a) * CASE WHEN t IS NULL THEN (least(pa, qa) + least(pb, qb)) / 2
  ELSE ((least(pa, qa) + pa + t * (pb - pa)) * t + (pa + t * (pb - pa) + least(pb, qb)) * (1 - t)) / 2 END), 6) AS area
  FROM ei GROUP BY ALL HAVING area > 0.5)"""


OWN = f"own AS (SELECT parcel_id, {AREA} AS own FROM le GROUP BY parcel_id)"
OVERLAPS = f"WITH {duck('fx_parcels', 'fx_zones')}, {duck_overlaps('fx_parcels', 'fx_zones', 'parcel_id', 'zone_id')}, {OWN}"
COVERAGE = "least((100 * area / own)::DECIMAL(20,6), 100)::DECIMAL(5,2) AS coverage_pct"


@query("c1_intersect_join", f"{OVERLAPS} SELECT parcel_id AS left_id, zone_id AS right_id, area::DECIMAL(12,2) AS intersection_area_m2, {COVERAGE} FROM ov JOIN own USING (parcel_id)")
def c1_intersect_join(spark, sf_dir):
    """Every overlap of a parcel and a zone by area and coverage."""
    return spatial.intersect_join(derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_zones"), "parcel_id", "zone_id").drop("left_mark", "right_mark")


@query("c2_dwithin_join")
def c2_dwithin_join(spark, sf_dir):
    """Parcels and zones at most 30 m apart (C2); held against brute force in the tests."""
    return spatial.dwithin_join(derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_zones"), "parcel_id", "zone_id", 30.0).withColumn("distance_m", F.round("distance_m", 4))


@query("c3_nearest_distance")
def c3_nearest_distance(spark, sf_dir):
    """Distance of each parcel to the nearest buildable zone, mixed zone and road, however far (C3); held against brute force in the tests.

    ``distance_m`` is that to the nearest buildable zone.
    """
    parcels, zones = derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_zones")
    out = parcels.select(F.col("parcel_id").alias("left_id"))
    for name, test in (("distance_m", p.is_buildable), ("distance_to_mixed_service_zone_m", p.is_mixed), ("distance_to_meaningful_road_m", p.is_road)):
        near = spatial.nearest_distance(parcels, zones.filter(test(F.col("symbol"))), "parcel_id", "zone_id")
        out = out.join(near.select("left_id", F.round("distance_m", 4).alias(name)), "left_id", "left")
    return out


@query("c4_shared_boundary")
def c4_shared_boundary(spark, sf_dir):
    """Shared boundary of every parcel with all zones within 5 m, the synthetic neighbours among them (C4); held against brute force in the tests."""
    parcels, zones = derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_zones").select("zone_id", "geom")
    beside = derived(spark, sf_dir, "fx_zones_adjacent").select((1_000_000 - F.col("zone_id") - 1).alias("zone_id"), "geom")  # negative ids, which no zone has
    out = spatial.shared_boundary(parcels, zones.unionByName(beside), "parcel_id", "zone_id")
    rows = parcels.select("parcel_id").join(out, F.col("parcel_id") == F.col("left_id"), "left")
    return rows.select("parcel_id", F.coalesce("shared_boundary_m", F.lit(0.0)).alias("own_shared_m"), F.col("adjacent_pct").alias("own_pct"))


NORMAL = """array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(upper(coalesce({0}, '')), '\\s+', '', 'g'),
  '([A-ZĄĆĘŁŃÓŚŹŻ])-([A-ZĄĆĘŁŃÓŚŹŻ])', '\\1/\\2', 'g'), '([A-ZĄĆĘŁŃÓŚŹŻ])-([A-ZĄĆĘŁŃÓŚŹŻ])', '\\1/\\2', 'g'), '/'),
  lambda s: regexp_replace(regexp_replace(regexp_replace(s, '^[0-9._-]+', ''), '[._-]*[0-9]+$', ''), '^[._-]+|[._-]+$', '', 'g')), lambda s: s <> ''), '/')"""
IS_BUILDABLE = f"{NORMAL.format('symbol')} IN ({', '.join(repr(s) for s in p.BUILDABLE)})"
AGRI, BUILT = (", ".join(repr(s) for s in x) for x in (p.AGRICULTURAL, p.BUILT))
GENUINE = f"({IS_BUILDABLE} AND (trim(coalesce(current_use, '')) = '' OR upper(trim(current_use)) = 'R_UNKNOWN' OR (trim(current_use) NOT IN ({BUILT}) AND trim(current_use) IN ({AGRI}))))"
DELTAS = f"""{OVERLAPS}, dl AS (SELECT *, {GENUINE} AS is_genuine, {GENUINE} AND (coverage_pct >= 30 OR intersection_area_m2 >= 500) AS qualifies FROM (
  SELECT parcel_id, zone_id, area::DECIMAL(12,2) AS intersection_area_m2, {COVERAGE}, match_confidence, current_use, fx_parcels.teryt_gmina, own::DECIMAL(12,2) AS area_m2, symbol, plan_type, plan_name
  FROM ov JOIN own USING (parcel_id) JOIN fx_parcels USING (parcel_id) JOIN fx_zones USING (zone_id)))"""
LEADS = f"""{DELTAS}, {duck('fx_listings')},
best AS (SELECT *, max(intersection_area_m2) OVER (PARTITION BY parcel_id) AS max_buildable_area_m2, match_confidence::DOUBLE * CASE WHEN coverage_pct >= 70 THEN 0.95 WHEN coverage_pct >= 50 THEN 0.9 WHEN coverage_pct >= 30 THEN 0.85 ELSE 0.5 END AS c
  FROM dl WHERE qualifies QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY coverage_pct DESC, zone_id) = 1),
latest AS (SELECT parcel_id, listing_id, price_zl FROM fx_listings QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY created_at DESC, listing_id DESC) = 1),
leads AS (SELECT parcel_id, teryt_gmina, round(c::DECIMAL(10,6), 2)::DECIMAL(3,2) AS confidence_score, CASE WHEN round(c, 6) >= 0.9 THEN 'high' WHEN round(c, 6) >= 0.75 THEN 'medium' ELSE 'low' END AS priority,
  coverage_pct AS max_coverage_pct, max_buildable_area_m2, symbol AS dominant_przeznaczenie, zone_id, plan_type, area_m2, listing_id, price_zl,
  CASE WHEN area_m2 > 0 THEN round_even((price_zl / area_m2)::DECIMAL(20,8), 2)::DECIMAL(12,2) END AS price_per_m2_zl FROM best LEFT JOIN latest USING (parcel_id))"""


@query("i1_zone_symbols", f"WITH {duck('fx_zones')} SELECT zone_id, {NORMAL.format('symbol')} AS normal, {IS_BUILDABLE} AS buildable FROM fx_zones")
def i1_zone_symbols(spark, sf_dir):
    """Normalised zone symbols and whether they are buildable."""
    return derived(spark, sf_dir, "fx_zones").select("zone_id", p.normalise_symbol(F.col("symbol")).alias("normal"), p.is_buildable(F.col("symbol")).alias("buildable"))


@query("i5_qualified_deltas", f"{DELTAS} SELECT parcel_id, zone_id, coverage_pct, is_genuine, qualifies FROM dl")
def i5_qualified_deltas(spark, sf_dir):
    """Deltas with the flags of genuine upgrade and lead qualification."""
    return delta.flags(derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_zones")).select("parcel_id", "zone_id", "coverage_pct", "is_genuine", "qualifies")


def leads(spark, sf_dir):
    return delta.run_delta(derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_zones"), derived(spark, sf_dir, "fx_listings"))


@query("k1_delta_leads", f"{LEADS} SELECT * FROM leads")
def k1_delta_leads(spark, sf_dir):
    """The delta plan end to end (K1: C1, I1, I5, I6, E4, E2, I7)."""
    return leads(spark, sf_dir)
