"""Registered queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck, duck_edges
from landspark.functions import geometry as g
from landspark.queries import AREA, query
from landspark.sources import geojson


def _collections(spark, sf_dir):
    """Zones as one feature collection for each hundred: (source_id, json)."""
    zones = derived(spark, sf_dir, "fx_zones").withColumn("source_id", (F.col("zone_id") / 100).cast("long"))
    closed = F.transform("geom", lambda a: F.transform(a, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda v: F.array(v["x"], v["y"]))))
    feature = F.struct(F.struct(F.col("symbol").alias("SYMBOL"), F.col("plan_name").alias("nazwa"), F.col("zone_id").cast("string").alias("id")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), closed.alias("coordinates")).alias("geometry"))
    return zones.groupBy("source_id").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("json"))


@query("a3_ingest_geojson", f"WITH {duck('fx_zones')}, {duck_edges('e', 'fx_zones', 'zone_id')}, a AS (SELECT zone_id, {AREA} AS area FROM e GROUP BY zone_id) SELECT upper(symbol) AS symbol, plan_name, count(*) AS n, round(sum(area), 2) AS area FROM fx_zones JOIN a USING (zone_id) GROUP BY ALL")
def a3_ingest_geojson(spark, sf_dir):
    """Zones read from feature collections with a field map for each source (A3)."""
    texts = _collections(spark, sf_dir)
    sources = texts.select("source_id", F.lit("126101199").alias("teryt_gmina"), F.lit("mpzp").alias("plan_type"), F.lit("symbol").alias("symbol_field"), F.lit("NAZWA").alias("name_field"))
    zones = geojson.ingest_geojson_zones(texts, sources)
    return zones.groupBy("symbol", "plan_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(g.area(F.col("geom"))), 2).alias("area"))


@query("b15_esri_rings", f"WITH {duck('fx_parcels')}, {duck_edges('e', 'fx_parcels', 'parcel_id')} SELECT parcel_id AS source_id, round({AREA}, 2) AS area FROM e GROUP BY parcel_id")
def b15_esri_rings(spark, sf_dir):
    """Polygons from Esri ring documents."""
    rings = F.transform(F.col("geom")[0], lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"])))
    texts = derived(spark, sf_dir, "fx_parcels").select(F.col("parcel_id").alias("source_id"), F.to_json(F.struct(rings.alias("rings"))).alias("json"))
    return geojson.from_esri_rings(texts).select("source_id", F.round(g.area(F.col("geom")), 2).alias("area"))


@query("a7_ingest_cadastre", f"WITH {duck('fx_parcels')} SELECT parcel_id // 100 AS source_id, teryt_gmina || '.' || parcel_id AS identifier, substr(teryt_gmina, 1, 4) AS county, teryt_gmina AS commune, '0001' AS region, parcel_id::VARCHAR AS parcel FROM fx_parcels WHERE parcel_id % 10 < 8")
def a7_ingest_cadastre(spark, sf_dir):
    """Parcels from pipe-delimited responses; a fifth of the lines is malformed."""
    line = F.when(F.col("parcel_id") % 10 < 8, F.concat_ws("|", F.concat("teryt_gmina", F.lit("."), F.col("parcel_id").cast("string")), F.substring("teryt_gmina", 1, 2), F.substring("teryt_gmina", 1, 4), "teryt_gmina", F.lit("0001"), F.col("parcel_id").cast("string"), F.lit("00"))).otherwise("broken|line")
    bodies = derived(spark, sf_dir, "fx_parcels").groupBy(F.expr("parcel_id div 100").alias("source_id")).agg(F.concat(F.lit("0\n"), F.array_join(F.collect_list(line), "\n")).alias("body"))
    return geojson.ingest_cadastre(bodies).select("source_id", F.col(geojson.CADASTRE[0]).alias("identifier"), "county", "commune", "region", "parcel")


@query("a8_ingest_regions", "SELECT '12610' || (c_custkey % 9 + 1) || '_1.' || c_custkey % 70 AS region_id, '12610' || (c_custkey % 9 + 1) || '1' AS commune_code, lpad((c_custkey % 70)::VARCHAR, 4, '0') AS region_code, c_name AS name FROM customer")
def a8_ingest_regions(spark, sf_dir):
    """Precinct directory rows: commune code and padded number."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("12610"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("_1."), (F.col("c_custkey") % 70).cast("string")).alias("region_id"), F.col("c_name").alias("name"))
    return geojson.ingest_regions(rows)


@query("a12_geojson_features")
def a12_geojson_features(spark, sf_dir):
    """Every zone as a GeoJSON feature in WGS84 (A12); the tests parse them."""
    return geojson.to_geojson_features(derived(spark, sf_dir, "fx_zones"), ["zone_id", "symbol"])


def _gml(spark, sf_dir):
    """Zones as GML texts in three dialects, about a hundred features each: (source_id, teryt_gmina, body)."""
    zones = derived(spark, sf_dir, "fx_zones").withColumn("source_id", F.expr("zone_id div 100"))
    number = lambda c: F.format_string("%.1f", c)
    ring = lambda tail: F.array_join(F.transform(F.concat(F.col("geom")[0][0], F.slice(F.col("geom")[0][0], 1, 1)), lambda v: F.concat(number(v["x"]), F.lit(" "), number(v["y"]), F.lit(tail))), " ")
    dialect = F.col("source_id") % 3
    surface = (
        F.when(dialect == 0, F.concat(F.lit("<gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>"), ring(""), F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface>")))
        .when(dialect == 1, F.concat(F.lit('<gml:Polygon srsDimension="3"><gml:exterior><gml:LinearRing><gml:posList>'), ring(" 7"), F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>")))
        .otherwise(F.concat(F.lit("<gml:Polygon><gml:outerBoundaryIs><gml:LinearRing><gml:coordinates>"), ring(""), F.lit("</gml:coordinates></gml:LinearRing></gml:outerBoundaryIs></gml:Polygon>")))
    )
    act = F.concat(F.lit("<app:plan><app:SYMBOL> "), "symbol", F.lit(" </app:SYMBOL><app:tytul>Plan &amp; "), F.col("zone_id").cast("string"), F.lit("</app:tytul><app:obowiazujeOd>2026-05-04</app:obowiazujeOd><app:geom>"), surface, F.lit("</app:geom></app:plan>"))
    member = F.when(dialect == 0, F.concat(F.lit("<wfs:member>"), act, F.lit("</wfs:member>"))).when(dialect == 1, F.concat(F.lit("<gml:featureMember>"), act, F.lit("</gml:featureMember>"))).otherwise(act)
    whole = lambda body: F.when(F.first(dialect) == 2, F.concat(F.lit("<wfs:FeatureCollection><gml:featureMembers>"), body, F.lit("</gml:featureMembers></wfs:FeatureCollection>"))).otherwise(F.concat(F.lit('<?xml version="1.0"?><wfs:FeatureCollection>'), body, F.lit("</wfs:FeatureCollection>")))
    return zones.groupBy("source_id").agg(whole(F.array_join(F.collect_list(member), "\n")).alias("body")).withColumn("teryt_gmina", F.lit("126101199"))


GML = f"WITH {duck('fx_zones')}, {duck_edges('e', 'fx_zones', 'zone_id')}, a AS (SELECT zone_id, {AREA} AS area FROM e GROUP BY zone_id)"


@query("a4_ingest_gml", f"{GML} SELECT 'Plan & ' || zone_id AS plan_name, upper(symbol) AS symbol, '1261011' AS teryt_gmina, round(area, 2) AS area FROM fx_zones JOIN a USING (zone_id)")
def a4_ingest_gml(spark, sf_dir):
    """Zones read from GML in three dialects (A4)."""
    from landspark.sources import gml

    texts = _gml(spark, sf_dir)
    sources = texts.select("source_id", "teryt_gmina", F.lit("mpzp").alias("plan_type"), F.lit("symbol").alias("symbol_field"), F.lit("tytul").alias("name_field"))
    return gml.ingest_gml_zones(texts.drop("teryt_gmina"), sources).select("plan_name", "symbol", "teryt_gmina", F.round(g.area(F.col("geom")), 2).alias("area"))


@query("a5_plan_extents", f"{GML} SELECT 'Plan & ' || zone_id AS plan_name, 'MPZP_PROJ' AS symbol, 'APP project extent: Plan & ' || zone_id AS description, DATE '2026-05-04' AS effective_date, round(area, 2) AS area FROM fx_zones JOIN a USING (zone_id)")
def a5_plan_extents(spark, sf_dir):
    """Extents of planned acts from GML (A5)."""
    from landspark.sources import gml

    return gml.ingest_plan_extents(_gml(spark, sf_dir)).select("plan_name", "symbol", "description", "effective_date", F.round(g.area(F.col("geom")), 2).alias("area"))
