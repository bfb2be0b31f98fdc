"""Registered queries of plan registers, legends, hints and point answers, from pages that are derived from the zones and other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck, duck_edges, pick, spark_sql
from landspark.operators import backlog, plan_pages as ops
from landspark.operators.spatial import match_plan_extents
from landspark.queries import query
from landspark.queries_reports import CENTROID
from landspark.storage import keep

Z = "cast(zone_id AS varchar(20))"
SHEET = "cast(zone_id // 20 AS varchar(20))"
#: A plan's box, grown by three kilometres; every eleventh page gives northings first.
BOX = "CASE WHEN zone_id % 11 = 0 THEN concat(y0 - 3000, ',', x0 - 3000, ',', y0 + h + 3000, ',', x0 + w + 3000) ELSE concat(x0 - 3000, ',', y0 - 3000, ',', x0 + w + 3000, ',', y0 + h + 3000) END"
ROW = f"""concat('<tr class="row mpzp"><td>', CASE WHEN zone_id % 17 > 0 THEN concat('P/', {Z}) ELSE ' ' END, '</td><td><b>', plan_name, '</b></td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td><td>',
  CASE WHEN zone_id % 3 < 2 THEN concat('<a href="legenda/', {SHEET}, '/index.html">l</a>') ELSE '' END, '</td><td><a href=''/app?id=', {Z}, '&amp;x=1''>a</a></td><td>9</td><td>', CASE WHEN zone_id % 4 = 0 THEN concat('<a href="../tif/', {Z}, '.tif">t</a>') ELSE '' END, '</td><td>11</td>',
  CASE WHEN zone_id % 19 > 0 THEN concat('<td><a href="https://mapy.test/?bbox=', replace({BOX}, ',', '%2C'), '&amp;resources=map:wms%40https%3A%2F%2Fwms.test%2Fplany%2F', substr(teryt_gmina, 1, 6), '%2F', {Z}, '">m</a></td>') ELSE '' END, '</tr>')"""
#: A sheet's row of a symbol: every other sheet names it by a code, the others in long words.
LABEL = f"CASE WHEN zone_id // 20 % 2 = 0 THEN concat('1', symbol, ' zabudowa numer ', {Z}) ELSE concat('zabudowa przeznaczona ', {Z}) END"
ENTRY = f"""concat('<tr><td>LEGENDA</td><td><img src="img/', {Z}, '.png"><img src="img/wspolny.png"></td><td>x</td><td><i>', {LABEL}, '</i></td></tr>')"""
CODED = f"regexp_replace(regexp_extract(upper({LABEL}), '([0-9]{{0,3}}[A-Z]{{1,6}}([-/.][A-Z0-9]{{1,6}})*)', 1), '^[0-9]+', '')"


def _pages(spark, sf_dir, row, head, tail, where):
    """Pages of twenty rows each: (source_id, source_url, body)."""
    zones = derived(spark, sf_dir, "fx_zones").selectExpr("zone_id", f"{spark_sql(row)} AS r", spark_sql("zone_id // 20 AS source_id"))
    body = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("zone_id", "r"))), lambda x: x["r"]), "\n"), F.lit(tail))
    return zones.groupBy("source_id").agg(body.alias("body")).withColumn("source_url", F.concat(F.lit(where[0]), F.col("source_id").cast("string"), F.lit(where[1])))


def _registers(spark, sf_dir):
    return _pages(spark, sf_dir, ROW, "<html><table><tr class='head'><td>Kod</td></tr>", "</table></html>", ("https://plan.test/wykaz/", "/wykazplanow.html"))


def _sheets(spark, sf_dir):
    return _pages(spark, sf_dir, ENTRY, "<table><tr><td>LEGENDA</td></tr><tr><td>dla planu Lipa</td></tr>", "</table>", ("https://plan.test/legenda/", "/sheet001.html"))


PLANS = f"""p AS (SELECT zone_id, zone_id // 20 AS source_id, 'P/' || {Z} AS plan_code, plan_name AS name, CASE WHEN zone_id % 3 < 2 THEN 'https://plan.test/wykaz/' || {SHEET} || '/legenda/' || {SHEET} || '/index.html' END AS legend_url,
  'https://plan.test/app?id=' || {Z} || '&x=1' AS app_url, CASE WHEN zone_id % 4 = 0 THEN 'https://plan.test/wykaz/tif/' || {Z} || '.tif' END AS picture_url, 'https://wms.test/plany/' || substr(teryt_gmina, 1, 6) || '/' || {Z} AS wms_url, substr(teryt_gmina, 1, 6) AS area_code,
  list_transform(string_split({BOX}, ','), lambda v: v::DOUBLE) AS b FROM fx_zones WHERE zone_id % 17 > 0 AND zone_id % 19 > 0)"""


@query("h29_plan_register", f"WITH {duck('fx_zones')}, {PLANS} SELECT source_id, plan_code, name, legend_url, app_url, picture_url, wms_url, area_code, b[1] AS minx, b[2] AS miny, b[3] AS maxx, b[4] AS maxy FROM p")
def h29_plan_register(spark, sf_dir):
    """Plans of all register pages; rows without a code or with too few cells are none."""
    return ops.plan_register(_registers(spark, sf_dir)).select("source_id", "plan_code", "name", "legend_url", "app_url", "picture_url", "wms_url", "area_code", "minx", "miny", "maxx", "maxy")


ENTRIES = f"e AS (SELECT zone_id // 20 AS source_id, unnest(['https://plan.test/legenda/' || {SHEET} || '/img/' || {Z} || '.png', 'https://plan.test/legenda/' || {SHEET} || '/img/wspolny.png']) AS image_url, {LABEL} AS label, CASE WHEN zone_id // 20 % 2 = 0 THEN {CODED} END AS designation FROM fx_zones)"


@query("h30_legend_entries", f"WITH {duck('fx_zones')}, {ENTRIES} SELECT source_id, 'planu Lipa' AS title, image_url, label, designation FROM e")
def h30_legend_entries(spark, sf_dir):
    """Entries of all legend sheets: pictures, labels and designations."""
    return ops.legend_entries(_sheets(spark, sf_dir)).select("source_id", "title", "image_url", "label", "designation")


@query(
    "i20_plan_states",
    f"""WITH {duck('fx_zones', 'fx_parcels')}, {PLANS}, {ENTRIES}, {duck_edges('g', 'fx_parcels', 'parcel_id')}, {CENTROID.replace('FROM e GROUP', 'FROM g GROUP')},
pp AS (SELECT substr(teryt_gmina, 1, 6) AS area_code, cx, cy FROM c JOIN fx_parcels USING (parcel_id)),
k AS (SELECT zone_id, count_if(cx BETWEEN b[1] AND b[3] AND cy BETWEEN b[2] AND b[4]) AS n, count_if(cy BETWEEN b[1] AND b[3] AND cx BETWEEN b[2] AND b[4]) AS s FROM p JOIN pp USING (area_code) GROUP BY zone_id),
l AS (SELECT source_id, count(*) AS entries, count(designation) AS coded FROM e GROUP BY source_id)
SELECT plan_code, CASE WHEN coalesce(k.n, 0) = 0 AND k.s > 0 THEN 'bbox_axis_suspect' WHEN k.n > 0 AND legend_url IS NOT NULL AND coded > 0 THEN 'ready' WHEN k.n > 0 AND legend_url IS NOT NULL THEN 'manual_override_required' ELSE 'source_discovered' END AS plan_state,
  CASE WHEN legend_url IS NULL THEN 'legend_missing_semantics' WHEN coded > 0 THEN 'ready' ELSE 'manual_override_required' END AS probe_state FROM p LEFT JOIN k USING (zone_id) LEFT JOIN l USING (source_id)""",
)
def i20_plan_states(spark, sf_dir):
    """Readiness of every plan of the registers, by the parcels in its box and what its legend says, and of its probe."""
    plans = keep(ops.plan_register(_registers(spark, sf_dir)).withColumn("zone_id", F.col("plan_code")), "plans")
    legends = ops.legend_entries(_sheets(spark, sf_dir)).groupBy("source_id").agg(F.count(F.lit(1)).alias("entries"), F.min("designation").alias("designation"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    boxes = plans.select(F.col("area_code").alias("teryt_gmina"), "zone_id", F.array(F.array(F.array(corner("minx", "miny"), corner("minx", "maxy"), corner("maxx", "maxy"), corner("maxx", "miny")))).alias("geom"))
    parcels = derived(spark, sf_dir, "fx_parcels").withColumn("teryt_gmina", F.substring("teryt_gmina", 1, 6))
    matched = match_plan_extents(parcels, boxes).select("zone_id", "n_hits", "bbox_axes_suspect")
    rows = plans.join(matched, "zone_id", "left").join(legends, "source_id", "left")
    has, known = F.col("legend_url").isNotNull(), F.col("designation").isNotNull()
    state = backlog.plan_state(F.coalesce("bbox_axes_suspect", F.lit(False)), F.coalesce("n_hits", F.lit(0)), has, known)
    probe = backlog.probe_state(F.when(has, F.col("designation")), F.when(has, F.col("entries")).otherwise(0))
    return rows.select("plan_code", state.alias("plan_state"), probe.alias("probe_state"))


HINTS = f"""SELECT o_orderkey AS id, {pick('o_orderkey % 4', 'Oznaczenie terenu', 'inne', 'SYMBOL', None)} AS k1, {pick('o_custkey % 5', '12MN', ' mnu. ', 'EXTENT', '', '3U/MN')} AS v1, o_custkey AS c,
  CASE o_orderkey % 3 WHEN 0 THEN concat('oznaczenie=1MW; numerplanu: KN_', o_custkey) WHEN 1 THEN concat('Teren ZP w sprawie ', o_custkey) END AS raw_text FROM orders"""


@query(
    "h31_feature_hints",
    f"""WITH h AS ({HINTS}) SELECT id, coalesce(CASE WHEN k1 IN ('Oznaczenie terenu', 'SYMBOL') THEN CASE v1 WHEN '12MN' THEN 'MN' WHEN ' mnu. ' THEN 'MNU' WHEN '3U/MN' THEN 'U/MN' END END, CASE id % 3 WHEN 0 THEN 'MW' WHEN 1 THEN 'TEREN' END) AS designation_hint,
  CASE WHEN c % 2 = 0 THEN 'plan ' || c WHEN id % 3 = 0 THEN 'KN_' || c END AS plan_name_hint FROM h""",
)
def h31_feature_hints(spark, sf_dir):
    """Designations and plans that attributes and texts of map answers hint at."""
    rows = spark.sql(spark_sql(HINTS).replace("FROM orders", "FROM {o}"), o=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    entries = F.filter(F.array(F.struct(F.col("k1").alias("k"), F.col("v1").alias("v")), F.struct(F.when(F.col("c") % 2 == 0, "Numer planu").alias("k"), F.concat(F.lit("plan "), F.col("c").cast("string")).alias("v"))), lambda e: e["k"].isNotNull())
    return ops.feature_hints(rows.select("id", F.map_from_entries(entries).alias("attributes"), "raw_text")).select("id", "designation_hint", "plan_name_hint")


ANSWERS = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS p, CASE l_linenumber % 4
  WHEN 0 THEN concat('@MPZP - przeznaczenia terenów OBJECTID;numerplanu;symbolzrastra;kategoriaprzeznaczeniaterenu; ', l_partkey, ';RS_', l_partkey, ';7MNU;zabudowa ;')
  WHEN 1 THEN concat('<div><b>Nazwa:</b> <strong>Plan <i>', l_partkey, '</i></strong><br/><b>Przeznaczenie:</b> <b> 16U </b> - usługi <br/><br/><b>Legenda:</b> <a href=''https://l.test/', l_partkey, '''>l</a> MPZP Nr: X/', l_partkey, '<br/></div>')
  WHEN 2 THEN '@krótko a;b;1' ELSE '<b>Nazwa:</b> <strong>bez przeznaczenia</strong>' END AS body FROM lineitem"""


@query(
    "h23_point_hits",
    f"""WITH a AS ({ANSWERS}) SELECT id, CASE WHEN id % 10 % 4 = 0 THEN 'semicolons' ELSE 'popup' END AS form, CASE WHEN id % 10 % 4 = 0 THEN 'MNU' ELSE 'U' END AS designation, CASE WHEN id % 10 % 4 = 0 THEN 'zabudowa' ELSE 'usługi' END AS description,
  CASE WHEN id % 10 % 4 = 0 THEN 'RS_' || p ELSE 'Plan ' || p END AS plan_name, CASE WHEN id % 10 % 4 = 1 THEN 'X/' || p END AS resolution, CASE WHEN id % 10 % 4 = 1 THEN 'https://l.test/' || p END AS legend_url FROM a WHERE id % 10 % 4 < 2""",
)
def h23_point_hits(spark, sf_dir):
    """Designations of points from answers of map services in two forms."""
    return ops.point_hits(spark.sql(ANSWERS.replace("FROM lineitem", "FROM {li}"), li=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))).drop("p")
