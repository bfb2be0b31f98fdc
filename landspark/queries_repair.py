"""Registered queries of repairs, resets, sampling grids and neighbourhoods of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck, duck_edges, pick, spark_sql
from landspark.functions import geometry as g
from landspark.operators import grids, override, places, polygons, repair
from landspark.queries import AREA, query
from landspark.queries_places import FORMS, NUMBER, PLACE
from landspark.queries_reports import CATEGORY
from landspark.queries_resolve import KEY
from landspark.storage import keep, new_path, publish, published

OLD = f"""{pick('listing_id % 7', 'same', None, '32', 'abc', '7', 'more', '12345')} AS old, {pick('listing_id // 7 % 5', None, 'w sądzie rejonowym', 'same', 'Las', '0005')} AS obreb,
  {pick('listing_id // 11 % 3', None, 'like', 'numer 5')} AS gmina"""
STORED = f"""CASE old WHEN 'same' THEN number WHEN 'more' THEN concat(number, '9') ELSE old END AS raw_numer, CASE obreb WHEN 'same' THEN place ELSE obreb END AS raw_obreb, CASE gmina WHEN 'like' THEN concat(place, 'e') ELSE gmina END AS raw_gmina"""


@query(
    "h24_reparse",
    f"""WITH {duck('fx_notices')}, n AS (SELECT listing_id, listing_id % 6 AS form, {NUMBER} AS number, {PLACE} AS place, {OLD} FROM fx_notices),
s AS (SELECT listing_id, form, number, place, {STORED} FROM n),
f AS (SELECT *, CASE WHEN form < 4 THEN place END AS found, CASE WHEN form <> 3 THEN number END AS cand FROM s),
g AS (SELECT *, CASE WHEN raw_gmina NOT LIKE 'numer%' AND 1 - levenshtein({KEY.format('found')}, {KEY.format('raw_gmina')})::DOUBLE / greatest(length(found), length(raw_gmina)) >= 0.84 THEN raw_gmina ELSE found END AS fresh FROM f),
d AS (SELECT *, CASE WHEN cand IS NULL OR cand = raw_numer THEN FALSE WHEN raw_numer IS NULL THEN TRUE WHEN form = 2 THEN FALSE ELSE NOT contains(raw_numer, '/') END AS rep, form = 3 AND coalesce(raw_numer = 'abc', FALSE) AS clr,
  CASE WHEN fresh IS NULL OR fresh = raw_obreb THEN FALSE WHEN raw_obreb IS NULL OR raw_obreb IN ('w sądzie rejonowym', '0005') THEN TRUE ELSE length(fresh) > length(raw_obreb) + 3 END AS better FROM g)
SELECT listing_id, CASE WHEN rep THEN 'replace' WHEN clr THEN 'clear' ELSE 'keep' END AS parcel_action, CASE WHEN rep THEN cand WHEN NOT clr THEN raw_numer END AS new_numer,
  CASE WHEN better THEN 'replace' ELSE 'keep' END AS precinct_action, CASE WHEN better THEN fresh ELSE raw_obreb END AS new_obreb FROM d WHERE rep OR clr OR better""",
)
def h24_reparse(spark, sf_dir):
    """Stored numbers and precincts against a fresh extraction of all notices: what is replaced or cleared."""
    rows = derived(spark, sf_dir, "fx_notices")
    rows = spark.sql(spark_sql(f"SELECT listing_id, {FORMS} AS raw_text, {NUMBER} AS number, {PLACE} AS place, {OLD} FROM {{rows}}"), rows=rows)
    listings = spark.sql(f"SELECT listing_id, raw_text, {STORED} FROM {{rows}}", rows=rows)
    docs = listings.select("listing_id", F.col("raw_text").alias("text"))
    named = keep(places.extract_localities(docs, "listing_id"), "localities")  # three steps read them
    return repair.reparse(listings, places.extract_parcels(docs, "listing_id", localities=named), named, places.extract_precinct(docs, "listing_id", localities=named))


NOW = "2026-01-01"


@query(
    "j10_reset_scope",
    f"""WITH {duck('fx_listings', 'fx_retry', 'fx_parcels', 'fx_leads')},
li AS (SELECT listing_id, substr(teryt_gmina, 1, 2) AS province, l.created_at < TIMESTAMP '1998-01-01' AS done FROM fx_listings l JOIN fx_parcels USING (parcel_id)), links AS (SELECT listing_id, parcel_id FROM fx_listings WHERE price_zl >= 20000),
here AS (SELECT * FROM li WHERE province = '12'), swept AS (SELECT *, {CATEGORY} AS category FROM fx_retry WHERE listing_id IN (SELECT listing_id FROM here) AND listing_id NOT IN (SELECT listing_id FROM links)),
q AS (SELECT listing_id, next_retry_at FROM swept WHERE category <> 'manual_only_case' UNION ALL SELECT listing_id, next_retry_at FROM fx_retry WHERE listing_id NOT IN (SELECT listing_id FROM here)),
t AS (SELECT DISTINCT listing_id FROM here WHERE NOT done OR listing_id IN (SELECT listing_id FROM q)), aff AS (SELECT DISTINCT parcel_id FROM links WHERE listing_id IN (SELECT listing_id FROM t)),
kept AS (SELECT * FROM links WHERE listing_id NOT IN (SELECT listing_id FROM t))
SELECT 'listings' AS table_name, listing_id AS id, (done AND listing_id NOT IN (SELECT listing_id FROM t))::VARCHAR AS detail FROM li
UNION ALL SELECT 'queue', listing_id, CASE WHEN listing_id IN (SELECT listing_id FROM t) THEN 'now' ELSE 'later' END FROM q
UNION ALL SELECT 'links', listing_id, parcel_id::VARCHAR FROM kept
UNION ALL SELECT 'leads', lead_id, parcel_id::VARCHAR FROM fx_leads WHERE parcel_id NOT IN (SELECT parcel_id FROM aff)
UNION ALL SELECT 'deltas', parcel_id, '' FROM fx_parcels WHERE parcel_id NOT IN (SELECT parcel_id FROM aff)
UNION ALL SELECT 'parcels', parcel_id, '' FROM fx_parcels WHERE parcel_id NOT IN (SELECT parcel_id FROM aff WHERE parcel_id NOT IN (SELECT parcel_id FROM kept))
UNION ALL SELECT 'backlog', listing_id, max(last_error) FROM swept WHERE category = 'manual_only_case' GROUP BY listing_id
UNION ALL SELECT 'backlog', listing_id, 'old' FROM fx_retry WHERE raw_obreb = 'Centrum' AND listing_id NOT IN (SELECT listing_id FROM swept WHERE category = 'manual_only_case')""",
)
def j10_reset_scope(spark, sf_dir):
    """All seven tables after the reset of a province."""
    parcels, listed = derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_listings")
    queue = derived(spark, sf_dir, "fx_retry").withColumn("next_retry_at", F.col("next_retry_at").cast("timestamp"))
    listings = listed.join(parcels.select("parcel_id", "teryt_gmina"), "parcel_id").select("listing_id", F.substring("teryt_gmina", 1, 2).alias("province"), (F.col("created_at") < F.to_timestamp(F.lit("1998-01-01"))).alias("is_processed"))
    tables = {
        "listings": listings, "queue": queue, "links": listed.filter("price_zl >= 20000").select("listing_id", "parcel_id"), "leads": derived(spark, sf_dir, "fx_leads").select("lead_id", "parcel_id"), "deltas": parcels.select("parcel_id"),
        "parcels": parcels.select("parcel_id"), "backlog": queue.filter("raw_obreb = 'Centrum'").select("listing_id", F.lit("old").alias("last_error")),
    }
    after, _ = repair.reset_scope(tables, F.to_timestamp(F.lit(NOW)), province="12")
    row = lambda name, key, detail: after[name].select(F.lit(name).alias("table_name"), F.col(key).alias("id"), detail.cast("string").alias("detail"))
    soon = F.when(F.col("next_retry_at") == F.to_timestamp(F.lit(NOW)), "now").otherwise("later")
    parts = [row("listings", "listing_id", F.col("is_processed")), row("queue", "listing_id", soon), row("links", "listing_id", F.col("parcel_id")), row("leads", "lead_id", F.col("parcel_id")), row("deltas", "parcel_id", F.lit("")), row("parcels", "parcel_id", F.lit("")), row("backlog", "listing_id", F.col("last_error"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


GRID = 4
HIT = pick("(parcel_id + ix * 3 + iy) % 5", "MN", "U", None, "ZL", "MW")


@query(
    "b19_sampling_grid",
    f"""WITH {duck('fx_parcels')}, {duck_edges('e', 'fx_parcels', 'parcel_id')},
c AS (SELECT parcel_id, k // {GRID} AS ix, k % {GRID} AS iy, x0::DOUBLE + (k // {GRID} + 0.5::DOUBLE) * w::DOUBLE / {GRID} AS x, y0::DOUBLE + (k % {GRID} + 0.5::DOUBLE) * h::DOUBLE / {GRID} AS y, w::DOUBLE * h::DOUBLE / {GRID * GRID} AS a FROM fx_parcels, range({GRID * GRID}) r(k)),
i AS (SELECT c.parcel_id, ix, iy, any_value(a) AS a FROM c JOIN e USING (parcel_id) GROUP BY c.parcel_id, ix, iy, x, y HAVING count_if((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1),
d AS (SELECT *, {HIT} AS designation FROM i)
SELECT parcel_id, designation, 'plan ' || parcel_id % 7 AS plan_name, count(*) AS n_cells, round(sum(a), 4) AS area, string_agg(ix || ':' || iy, ',' ORDER BY ix, iy) AS cells FROM d WHERE designation IS NOT NULL GROUP BY parcel_id, designation""",
)
def b19_sampling_grid(spark, sf_dir):
    """Approximate zones of all parcels from what is found at the centres of their grids' cells."""
    cells = keep(grids.grid_cells(derived(spark, sf_dir, "fx_parcels"), GRID), "cells")  # both sides of the join read them
    hits = cells.selectExpr("parcel_id", "ix", "iy", f"{HIT} AS designation", "cast(null AS string) AS description", "concat('plan ', parcel_id % 7) AS plan_name", "cast(null AS string) AS resolution")
    zones = grids.sampled_zones(cells, hits)
    return zones.select("parcel_id", "designation", "plan_name", "n_cells", F.round("area", 4).alias("area"), F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["ix"].cast("string"), c["iy"].cast("string"))), ",").alias("cells"))


SIDE, REACH = 32, 3
SHADES = ((255, 255, 255), (200, 30, 30), (30, 200, 30), (255, 255, 255), (30, 30, 200), (255, 255, 255))
PIXELS = "SELECT o_orderkey // 1024 AS image_id, o_orderkey % 32 AS px, o_orderkey // 32 % 32 AS py, " + ", ".join(f"{pick('(o_custkey + o_orderkey // 7) % 6', *(s[i] for s in SHADES))} AS {c}" for i, c in enumerate("rgb")) + " FROM orders"
POINTS = "SELECT c_custkey AS id, c_custkey * 10 // 1024 AS image_id, c_custkey * 7 % 32 AS px, c_custkey * 13 % 32 AS py FROM customer"


@query(
    "d28_neighbourhood_mode",
    f"""WITH pixels AS ({PIXELS}), points AS ({POINTS}),
k AS (SELECT id, image_id, k, greatest(0, least({SIDE - 1}, px + k // {2 * REACH + 1} - {REACH})) AS px, greatest(0, least({SIDE - 1}, py + k % {2 * REACH + 1} - {REACH})) AS py FROM points, range({(2 * REACH + 1) ** 2}) r(k)),
n AS (SELECT id, r, g, b, count(*) AS n, min(k) AS f FROM k JOIN pixels USING (image_id, px, py) GROUP BY id, r, g, b)
SELECT id, r, g, b, n FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY r + g + b < 765 DESC, n DESC, f) = 1""",
)
def d28_neighbourhood_mode(spark, sf_dir):
    """The colour around each of a table's points in pictures of 1,024 pixels, without white unless there is nothing else."""
    read = lambda sql, table: spark.sql(spark_sql(sql).replace(f"FROM {table}", "FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    pixels, points = read(PIXELS, "orders"), read(POINTS, "customer")
    size = pixels.select("image_id").distinct().select("image_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))
    white = (F.col("r") == 255) & (F.col("g") == 255) & (F.col("b") == 255)
    return grids.neighbourhood_mode(points, pixels, size, white, REACH)


DECISION = pick("parcel_id % 5", "MN", "ZL", "19.U", "R", " MW/U-2 ")


@query(
    "j12_manual_override",
    f"""WITH {duck('fx_parcels', 'fx_leads', 'fx_listings')}, {duck_edges('e', 'fx_parcels', 'parcel_id')}, own AS (SELECT parcel_id, ({AREA})::DECIMAL(12,2) AS area FROM e GROUP BY parcel_id),
d AS (SELECT parcel_id, trim({DECISION}) AS symbol, CASE WHEN parcel_id % 5 IN (1, 3) THEN 'not_buildable' WHEN parcel_id IN (SELECT parcel_id FROM fx_leads WHERE strategy_type = 'current_buildable') THEN 'has_lead' ELSE 'accepted' END AS outcome, match_confidence, teryt_gmina FROM fx_parcels WHERE match_confidence >= 0.9),
l AS (SELECT parcel_id, listing_id, price_zl FROM fx_listings QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY created_at DESC, listing_id DESC) = 1),
a AS (SELECT *, 'manual:' || parcel_id || ':' || CASE symbol WHEN 'MN' THEN 'MN' WHEN '19.U' THEN 'U' ELSE 'MW/U' END AS zone_id FROM d JOIN own USING (parcel_id) LEFT JOIN l USING (parcel_id) WHERE outcome = 'accepted')
SELECT 'judged' AS table_name, parcel_id, symbol, outcome AS detail, NULL::DECIMAL(12,2) AS number FROM d
UNION ALL SELECT 'zones', parcel_id, symbol, zone_id, area FROM a
UNION ALL SELECT 'deltas', parcel_id, symbol, zone_id, area FROM a
UNION ALL SELECT 'leads', parcel_id, symbol, CASE WHEN match_confidence * 0.95 >= 0.9 THEN 'high' WHEN match_confidence * 0.95 >= 0.75 THEN 'medium' ELSE 'low' END, CASE WHEN area > 0 THEN round_even((price_zl / area)::DECIMAL(20,8), 2) END FROM a""",
)
def j12_manual_override(spark, sf_dir):
    """Decisions on all surely matched parcels, and the zones, deltas and leads of the version that they make."""
    parcels, listings = derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_listings")
    led = derived(spark, sf_dir, "fx_leads").filter("strategy_type = 'current_buildable'").select("parcel_id")
    decisions = parcels.filter("match_confidence >= 0.9").selectExpr("parcel_id", f"{DECISION} AS symbol", "created_at AS decided_at")
    judged = keep(override.judge(decisions, parcels, led), "judged")
    kinds = {
        "zones": "zone_id string, source string, teryt_gmina string, symbol string, plan_type string, plan_name string, resolution string, geom array<array<array<struct<x: double, y: double>>>>",
        "deltas": "parcel_id long, zone_id string, coverage_pct decimal(5,2), intersection_area_m2 decimal(12,2), use_before string, symbol string, delta_score decimal(3,2)",
        "leads": "parcel_id long, zone_id string, dominant_przeznaczenie string, priority string, confidence_score decimal(3,2), price_per_m2_zl decimal(12,2)",
    }
    made = override.override({k: spark.createDataFrame([], v) for k, v in kinds.items()}, parcels, listings, judged)
    root = new_path(spark, "overrides")
    publish(made, root)
    t = published(spark, root)
    number = F.lit(None).cast("decimal(12,2)")
    own = t["zones"].select(F.lit("zones").alias("table_name"), F.split("zone_id", ":")[1].cast("long").alias("parcel_id"), "symbol", F.col("zone_id").alias("detail"), g.area(F.col("geom")).cast("decimal(12,2)").alias("number"))
    rows = judged.select(F.lit("judged").alias("table_name"), "parcel_id", "symbol", F.col("outcome").alias("detail"), number.alias("number")).union(own)
    rows = rows.union(t["deltas"].select(F.lit("deltas"), "parcel_id", "symbol", "zone_id", "intersection_area_m2"))
    return rows.union(t["leads"].select(F.lit("leads"), "parcel_id", "dominant_przeznaczenie", "priority", "price_per_m2_zl"))


#: Landed rings by the parcel's key modulo eight: open, crossed, of two vertices, flat, with a spike; the others closed and simple.
LANDED = """CASE parcel_id % 8 WHEN 1 THEN slice(r, 1, size(r) - 1)
  WHEN 2 THEN array(r[0], named_struct('x', cast(x0 + w AS double), 'y', cast(y0 + h AS double)), named_struct('x', cast(x0 + w AS double), 'y', cast(y0 AS double)), named_struct('x', cast(x0 AS double), 'y', cast(y0 + h AS double)), r[0])
  WHEN 3 THEN array(r[0], r[1], r[0]) WHEN 4 THEN array(r[0], r[1], named_struct('x', r[0].x, 'y', r[0].y + h / 2), r[0])
  WHEN 5 THEN concat(slice(r, 1, 2), array(named_struct('x', r[1].x, 'y', r[1].y + 5), r[1]), slice(r, 3, size(r) - 2)) ELSE r END"""


@query(
    "b2_polygon_faults",
    f"WITH {duck('fx_parcels')} SELECT parcel_id, CASE parcel_id % 8 WHEN 1 THEN 'open_ring' WHEN 2 THEN 'self_crossing,zero_area' WHEN 3 THEN 'short_ring' WHEN 4 THEN 'self_crossing,zero_area' WHEN 5 THEN 'self_crossing' END AS reasons FROM fx_parcels WHERE parcel_id % 8 BETWEEN 1 AND 5",
)
def b2_polygon_faults(spark, sf_dir):
    """Faults of landed polygons, with their reasons (B2)."""
    rows = derived(spark, sf_dir, "fx_parcels").withColumn("r", F.concat(F.col("geom")[0][0], F.slice(F.col("geom")[0][0], 1, 1)))
    landed = keep(rows.select("parcel_id", F.array(F.array(F.expr(LANDED))).alias("geom")), "landed")  # each check reads them
    return polygons.polygon_faults(landed, "parcel_id").select("parcel_id", F.array_join("reasons", ",").alias("reasons"))
