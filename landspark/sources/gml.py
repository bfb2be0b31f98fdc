"""Zones and plan extents from landed GML texts, by expressions on the text; no document leaves its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.operators.backlog import signal_date

NAME = r"(?:[\w.-]+:)?[\w.-]+"
PREFIX = r"(?:[\w.-]+:)?"
OPEN = r"(?:\s(?:[^>]*[^/>])?)?>"
CHILD = rf"(?s)<({NAME}){OPEN}.*?</\1>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _element(names: str) -> str:
    """A pattern of a whole element with one of ``names``, whatever its prefix."""
    return rf"(?s)<({PREFIX}(?:{names})){OPEN}.*?</\1>"


def _inside(element: Column) -> Column:
    return F.regexp_extract(element, r"(?s)^\s*<[^>]*>(.*)</[^>]*>\s*$", 1)


def features(body: Column) -> Column:
    """The feature elements of a collection: of its members, else of its list of members, else the root's children but bounds."""
    members = F.transform(F.regexp_extract_all(body, F.lit(_element("member|featureMember")), 0), _inside)
    listed = F.regexp_extract_all(_inside(F.regexp_extract(body, _element("members|featureMembers"), 0)), F.lit(CHILD), 0)
    root = F.regexp_replace(body, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*", "")
    children = F.filter(F.regexp_extract_all(_inside(root), F.lit(CHILD), 0), lambda e: ~e.rlike(rf"^<{PREFIX}boundedBy"))
    failed = root.rlike(rf"^<{PREFIX}ExceptionReport\b")
    return F.when(failed, F.array().cast("array<string>")).when(F.size(members) > 0, members).when(F.size(listed) > 0, listed).otherwise(children)


def _points(ring: Column, polygon: Column) -> Column:
    """Vertices of a ring element: pairs of its numbers, two by two or by the dimension that it or its polygon names; empty if they are no numbers."""
    tag = F.regexp_extract(ring, rf"<{PREFIX}(?:posList|coordinates)\b[^>]*>", 0)
    dimension = lambda text: F.nullif(F.regexp_extract(text, r"^[^>]*?\b(?:srsDimension|dimension)=[\"'](\d+)[\"']", 1), F.lit("")).cast("int")
    step = F.coalesce(*(F.when(dimension(x) >= 2, dimension(x)) for x in (tag, ring, polygon)), F.lit(2))
    text = F.trim(F.regexp_replace(F.regexp_extract(ring, rf"<{PREFIX}(?:posList|coordinates)\b[^>]*>([^<]*)<", 1), r"[\s,]+", " "))
    numbers = F.transform(F.split(text, " "), lambda x: x.try_cast("double"))

    def pairs(x: Column) -> Column:
        n = F.floor(F.size(x["v"]) / x["k"]).cast("int")
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        points = F.transform(at, lambda i: F.struct(F.get(x["v"], i * x["k"]).alias("x"), F.get(x["v"], i * x["k"] + 1).alias("y")))
        return F.when(F.exists(x["v"], lambda v: v.isNull()), F.slice(points, 1, 0)).otherwise(points)

    return F.get(F.transform(F.array(F.struct(numbers.alias("v"), step.alias("k"))), pairs), F.lit(0))


def _polygons(element: Column) -> Column:
    """Nested rings of all polygons in an element; those whose outer ring has under three points are left out."""

    def rings(polygon: Column) -> Column:
        of = lambda names: F.transform(F.regexp_extract_all(polygon, F.lit(_element(names)), 0), lambda r: _points(r, polygon))
        return F.concat(of("exterior|outerBoundaryIs"), F.filter(of("interior|innerBoundaryIs"), lambda r: F.size(r) >= 3))

    found = F.transform(F.regexp_extract_all(element, F.lit(_element("Polygon")), 0), rings)
    return F.filter(found, lambda p: (F.size(p) > 0) & (F.size(F.get(p, F.lit(0))) >= 3))


def read_features(texts: DataFrame) -> DataFrame:
    """Features of GML texts (source_id, body, ...): the columns but ``body``, properties (array of key, value) and geom.

    Properties are the plain texts of a feature's children; of children with polygons the last one is its geometry, and features
    without any are left out.  Namespaces are not told apart.  A service's exception report, a null and an empty text have none.
    """
    kept = [c for c in texts.columns if c != "body"]
    rows = texts.select(*kept, F.explode(features(F.col("body"))).alias("_f")).select(*kept, F.regexp_extract_all(_inside(F.col("_f")), F.lit(CHILD), 0).alias("_c"))
    shaped = lambda e: e.rlike(rf"<{PREFIX}Polygon\b")
    def plain(e: Column) -> Column:
        out = F.regexp_replace(F.regexp_extract(e, r"^<[^>]*>([^<]*)", 1), r"^\s+|\s+$", "")
        for name, char in ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(char))
        return out

    entry = lambda e: F.struct(F.regexp_extract(e, rf"^<{PREFIX}([\w.-]+)", 1).alias("key"), plain(e).alias("value"))

    properties = F.filter(F.transform(F.filter("_c", lambda e: ~shaped(e)), entry), lambda p: p["value"] != "")
    geoms = F.filter(F.transform(F.filter("_c", shaped), _polygons), lambda x: F.size(x) > 0)
    rows = rows.select(*kept, properties.alias("properties"), F.explode(F.slice(F.reverse(geoms), 1, 1)).alias("geom"))
    return rows.withColumn("geom", g.normalise_rings(F.col("geom")))


def field(name: Column) -> Column:
    """The property of a name as given, in lower or in upper case; of several the last."""
    last = lambda key: F.get(F.reverse(F.filter("properties", lambda p: p["key"] == key)), F.lit(0))["value"]
    return F.coalesce(last(name), last(F.lower(name)), last(F.upper(name)))


def ingest_gml_zones(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """Zone rows of GML texts (source_id, body); ``sources`` and rows as of ``geojson.ingest_geojson_zones``."""
    rows = read_features(texts.join(sources, "source_id"))
    out = rows.select("source_id", F.substring("teryt_gmina", 1, 7).alias("teryt_gmina"), "plan_type", F.upper(F.trim(field(F.col("symbol_field")))).alias("symbol"), F.coalesce(field(F.col("name_field")), F.lit("MPZP")).alias("plan_name"), "geom")
    return out.filter(F.coalesce("symbol", F.lit("")) != "")


def ingest_plan_extents(texts: DataFrame, designation: str = "MPZP_PROJ", prefix: str = "APP project extent") -> DataFrame:
    """Extents of planned acts (source_id, teryt_gmina, body) as zones of one fixed designation; acts without a title are left out."""
    rows = read_features(texts).withColumn("plan_name", field(F.lit("tytul"))).filter("plan_name IS NOT NULL")
    return rows.select(
        "source_id", F.substring("teryt_gmina", 1, 7).alias("teryt_gmina"), F.lit("mpzp").alias("plan_type"), F.lit(designation).alias("symbol"), "plan_name", field(F.lit("identifier")).alias("resolution"),
        F.concat(F.lit(prefix + ": "), "plan_name").alias("description"), signal_date(field(F.lit("obowiazujeOd"))).alias("effective_date"), "geom",
    )
