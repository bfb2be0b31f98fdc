"""Zones from landed GeoJSON texts and Esri ring documents, cadastre responses, and feature output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.operators.sizes import spread

FEATURES = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"


def _rings(coordinates: Column, kind: Column) -> Column:
    """Polygon or MultiPolygon coordinates, as JSON text, to nested rings."""
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    single = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    nested = F.when(kind == "MultiPolygon", multi).when(kind == "Polygon", single)
    return g.normalise_rings(F.transform(nested, lambda a: F.transform(a, lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))))


def _field(properties: Column, name: Column) -> Column:
    """A property by its name as given, in lower or in upper case."""
    return F.coalesce(F.element_at(properties, name), F.element_at(properties, F.lower(name)), F.element_at(properties, F.upper(name)))


def ingest_geojson_zones(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """Zone rows from feature collections: ``texts`` (source_id, json) and ``sources`` (source_id, teryt_gmina, symbol_field, name_field, plan_type).

    Features without a symbol or a polygon are left out; symbols are upper case; the commune code keeps seven characters.
    """
    rows = texts.join(sources, "source_id").select("source_id", F.substring("teryt_gmina", 1, 7).alias("teryt_gmina"), "plan_type", "symbol_field", "name_field", F.explode(F.from_json("json", FEATURES)["features"]).alias("f"))
    symbol = F.upper(F.trim(_field(F.col("f.properties"), F.col("symbol_field"))))
    out = rows.select("source_id", "teryt_gmina", "plan_type", symbol.alias("symbol"), F.coalesce(_field(F.col("f.properties"), F.col("name_field")), F.lit("MPZP")).alias("plan_name"), _rings(F.col("f.geometry.coordinates"), F.col("f.geometry.type")).alias("geom"))
    return out.filter((F.coalesce("symbol", F.lit("")) != "") & (F.size("geom") > 0))


def from_esri_rings(texts: DataFrame) -> DataFrame:
    """(source_id, geom) of Esri documents ``{"rings": [...]}``: a ring that turns like the first one begins a polygon, others are its holes."""
    rings = F.from_json("json", "struct<rings:array<array<array<double>>>>")["rings"]
    points = F.transform(rings, lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))
    rows = texts.select("source_id", points.alias("_r"))
    first = g.ring_area(F.get("_r", F.lit(0))) < 0
    begins = F.filter(F.transform("_r", lambda r, i: F.when((g.ring_area(r) < 0) == first, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_b", begins)
    polygons = F.transform("_b", lambda i, k: F.slice("_r", i + 1, F.coalesce(F.get("_b", k + 1), F.size("_r")) - i))
    return rows.select("source_id", g.normalise_rings(polygons).alias("geom"))


CADASTRE = ("identifier", "voivodship", "county", "commune", "region", "parcel", "geom_wkb")


def ingest_cadastre(texts: DataFrame) -> DataFrame:
    """Rows of pipe-delimited responses (source_id, body) below their status line; lines of another shape are left out."""
    lines = texts.select("source_id", F.posexplode(F.split("body", r"\r?\n")).alias("line", "row")).filter("line > 0")
    parts = F.split("row", r"\|", -1)
    return lines.filter(F.size(parts) == len(CADASTRE)).select("source_id", *(F.trim(parts[i]).alias(c) for i, c in enumerate(CADASTRE)))


def ingest_regions(rows: DataFrame) -> DataFrame:
    """Precincts (region_id as commune.number, name) to commune code and a zero-padded number."""
    return rows.select("region_id", F.regexp_replace(F.substring_index("region_id", ".", 1), "_", "").alias("commune_code"), F.lpad(F.substring_index("region_id", ".", -1), 4, "0").alias("region_code"), F.trim("name").alias("name"))


def to_geojson_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature for each row, in WGS84, with a display point among its properties."""
    shown = g.with_display_point(spread(df)).withColumn("_p", g.to_4326(F.col("display_point.x"), F.col("display_point.y")))

    def closed(ring):
        whole = F.concat(ring, F.slice(ring, 1, 1))
        return F.transform(whole, lambda v: g.let(g.to_4326(v["x"], v["y"]), lambda w: F.array(F.round(w["x"], 7), F.round(w["y"], 7))))

    coordinates = F.transform("geom", lambda a: F.transform(a, closed))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(*properties, F.array(F.round("_p.x", 7), F.round("_p.y", 7)).alias("display_point")).alias("properties"),
    )
    return shown.select(*properties, F.to_json(feature).alias("feature"))
