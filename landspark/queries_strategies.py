"""Registered queries of place-name inflection, inferred communes, and the seven strategies of resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck
from landspark.functions import text as t
from landspark.operators import strategies as ops
from landspark.operators.tables import newest
from landspark.queries import query
from landspark.queries_resolve import KEY
from landspark.storage import keep

UNITS = [("Nowa Huta", "NH", "1201011"), ("Krowodrza", "K", "1201011"), ("Śródmieście", "S", "1201011"), ("Podgórze", "P", "1201011")]
WOJ = "CASE raw_woj WHEN 'małopolskie' THEN '12' WHEN 'podkarpackie' THEN '18' WHEN 'śląskie' THEN '24' END"


def tables(spark, sf_dir, named=False):
    """Listings, notices, cadastre, cities (``named``: kept, to be read more than once), units, register, rules, overrides and inflected names."""
    plots = newest(derived(spark, sf_dir, "fx_plots"), ["cad_id"], [F.asc("k")])
    cities = derived(spark, sf_dir, "fx_cities")
    cities = keep(cities, "cities") if named else cities
    notices = derived(spark, sf_dir, "fx_enriched").select("listing_id", F.array("number_1", "number_2").alias("numbers"), "text")
    overrides = derived(spark, sf_dir, "fx_overrides").select("kw", F.array("number").alias("numbers"), "obreb")
    units = spark.createDataFrame(UNITS, "name string, prefix string, commune string")
    rules = cities.select(F.col("name").alias("locality"), F.col("name").alias("commune_name"), F.lit(None).cast("string").alias("region_name")).distinct()
    forms = cities.select(F.concat("name", F.lit("u")).alias("form"), F.col("name").alias("nominative")).distinct()
    return {"listings": derived(spark, sf_dir, "fx_cases"), "notices": notices, "cadastre": plots, "cities": cities, "units": units, "register": plots, "rules": rules, "overrides": overrides, "forms": forms}


def chosen(name: str, source: str, keys: str) -> str:
    """CTEs of the choice among candidates (here, ca, area_m2) of each key: ``name`` (keys, cad_id, alone)."""
    return f"""{name}_g AS (SELECT *, count(*) OVER w AS n, count_if(here) OVER w AS nh FROM {source} WINDOW w AS (PARTITION BY {keys})),
{name}_h AS (SELECT *, coalesce((nh = 0 OR here) AND ca BETWEEN area_m2 * 0.95 AND area_m2 * 1.05 AND area_m2 > 0, FALSE) AS near FROM {name}_g),
{name}_i AS (SELECT *, count_if(near) OVER (PARTITION BY {keys}) AS nn FROM {name}_h),
{name} AS (SELECT {keys}, cad_id, n = 1 OR (nh = 1 AND here) AS alone FROM {name}_i WHERE n = 1 OR (nh = 1 AND here) OR (n > 1 AND nh <> 1 AND nn = 1 AND near))"""


def words(column: str) -> str:
    return f"' ' || trim(regexp_replace({KEY.format(column)}, '[^a-z0-9]+', ' ', 'g')) || ' '"


BASE = f"""WITH {duck('fx_plots', 'fx_cases', 'fx_cities', 'fx_enriched', 'fx_overrides')},
cad AS (SELECT *, {KEY.format('region_name')} AS rk FROM fx_plots QUALIFY row_number() OVER (PARTITION BY cad_id ORDER BY k) = 1),
l AS (SELECT *, {WOJ} AS w, CASE WHEN form IN (1, 3, 8) THEN {KEY.format("regexp_replace(raw_obreb, '^[0-9]{4} ', '')")} END AS pk FROM fx_cases)"""
BY_ID = "by_id AS (SELECT listing_id, cad_id, 'teryt_exact' AS method FROM (SELECT listing_id, substr(raw_obreb, 1, 7) || '.' || lpad(substr(raw_obreb, 8, 2), 4, '0') || '.' || raw_numer AS cad_id FROM l WHERE form = 0) SEMI JOIN cad USING (cad_id))"
BY_NAME = f"""nf AS (SELECT listing_id, l.area_m2, cad_id, cad.area_m2 AS ca, w IS NOT DISTINCT FROM woj AS here FROM l JOIN cad ON pk = rk AND raw_numer = number), {chosen('nc', 'nf', 'listing_id')},
by_name AS (SELECT listing_id, cad_id, CASE WHEN alone THEN 'teryt_exact' ELSE 'uldk_partial' END AS method FROM nc)"""
BY_TEXT = f"""tf AS (SELECT listing_id, l.area_m2, cad_id, cad.area_m2 AS ca, w IS NOT DISTINCT FROM woj AS here FROM l JOIN cad ON {KEY.format("regexp_extract(raw_text, '33-250 (.*), poczta', 1)")} = rk AND raw_numer = number WHERE form = 2 AND NOT contains(rk, '-') AND NOT regexp_matches(rk, '[0-9]')), {chosen('tc', 'tf', 'listing_id')},
by_text AS (SELECT listing_id, cad_id, 'uldk_partial' AS method FROM tc)"""
HINTS = f"""h AS (SELECT l.*, e.text AS notice, CASE WHEN o.kw IS NULL THEN [number_1, number_2] ELSE [o.number] END AS numbers, coalesce({KEY.format('o.obreb')}, pk) AS hk FROM l LEFT JOIN fx_enriched e USING (listing_id) LEFT JOIN fx_overrides o ON o.kw = replace(raw_kw, ' ', '')
  WHERE o.kw IS NOT NULL OR e.listing_id IS NOT NULL)"""
BY_NOTICE = f"""xn AS (SELECT DISTINCT listing_id, area_m2, w, raw_kw, hk, unnest(numbers) AS num FROM h),
xf AS (SELECT listing_id, num, xn.area_m2, cad_id, cad.area_m2 AS ca, w IS NOT DISTINCT FROM woj AS here FROM xn JOIN cad ON hk = rk AND num = number), {chosen('xc', 'xf', 'listing_id, num')},
by_notice AS (SELECT DISTINCT listing_id, cad_id, CASE WHEN raw_kw <> '' THEN 'kw_lookup' ELSE 'uldk_partial' END AS method FROM xc JOIN l USING (listing_id))"""
UNIT = "CASE regexp_extract(e.text, 'ewid. (.*), obr', 1) " + " ".join(f"WHEN '{n}' THEN '{p}'" for n, p, _ in UNITS) + " END"
BY_UNIT = f"""by_unit AS (SELECT DISTINCT listing_id, cad_id, CASE WHEN raw_kw <> '' THEN 'kw_lookup' ELSE 'manual' END AS method
  FROM l JOIN fx_enriched e USING (listing_id) JOIN cad ON commune = '1201011' AND region_name = {UNIT} || '-' || regexp_extract(e.text, 'obręb ([0-9]+)', 1) AND number IN (number_1, number_2) WHERE w = '12' AND form = 4)"""
BY_REGISTER = """rf AS (SELECT listing_id, number, count(DISTINCT cad_id) AS n, min(cad_id) AS cad_id, min(raw_kw) AS kw FROM (SELECT listing_id, raw_gmina, raw_kw, unnest([number_1, number_2]) AS num FROM l JOIN fx_enriched USING (listing_id) WHERE w = '12' AND form = 5) JOIN cad ON raw_gmina = commune_name AND num = number GROUP BY listing_id, number),
by_register AS (SELECT DISTINCT listing_id, cad_id, CASE WHEN kw <> '' THEN 'kw_lookup' ELSE 'manual' END AS method FROM rf WHERE n = 1)"""
COMMUNE = f"""names AS (SELECT DISTINCT unnest([{KEY.format('name')}, {KEY.format('name')} || 'u']) AS key, commune FROM fx_cities),
wins AS (SELECT listing_id, w, 0 AS source, {words("regexp_replace(raw_text, ' ?Komornik S.*', '')")} AS x FROM l UNION ALL SELECT listing_id, w, 1, {words('raw_text')} FROM l
  UNION ALL SELECT listing_id, w, -1, {words("regexp_replace(raw_gmina, '([aeiyąę])w$', '\\1')")} FROM l WHERE raw_gmina IS NOT NULL),
inferred AS (SELECT listing_id, min_by(commune, (source, -length(key), key, commune)) AS commune FROM wins JOIN names ON contains(x, ' ' || key || ' ') AND (w IS NULL OR w = substr(commune, 1, 2)) GROUP BY listing_id)"""
BY_CITY = f"""{COMMUNE},
cf AS (SELECT listing_id, cad_id, region_code = lpad(regexp_extract(raw_text, 'obręb ([0-9]+)', 1), 4, '0') AS t1, TRUE AS t2, contains({words('raw_text')}, {words('region_name')}) AS t3, coalesce(cad.area_m2 BETWEEN l.area_m2 * 0.95 AND l.area_m2 * 1.05 AND l.area_m2 > 0, FALSE) AS t4
  FROM l JOIN inferred USING (listing_id) JOIN cad USING (commune) WHERE raw_numer <> '' AND raw_numer = number),
cg AS (SELECT *, count_if(t1) OVER w AS n1, count_if(t2) OVER w AS n2, count_if(t3) OVER w AS n3, count_if(t4) OVER w AS n4 FROM cf WINDOW w AS (PARTITION BY listing_id)),
by_city AS (SELECT listing_id, cad_id, 'uldk_partial' AS method FROM cg WHERE CASE WHEN n1 = 1 THEN t1 WHEN n2 = 1 THEN t2 WHEN n3 = 1 THEN t3 WHEN n4 = 1 THEN t4 ELSE FALSE END)"""


@query("h19_nominative", f"""WITH {duck('fx_cases', 'fx_plots')}, n AS (SELECT listing_id, [raw_obreb, 'Frelichowie', 'Zakopanem', 'Nowym Sączu', 'Ropica Górnaw', 'Niedurnego', 'Ofiar Września', 'Rudzie-Śląskiej', NULL][listing_id % 9 + 1] AS name FROM fx_cases)
SELECT listing_id, name, CASE listing_id % 9 WHEN 1 THEN 'Frelichów' WHEN 2 THEN 'Zakopane' WHEN 3 THEN 'Nowy Sącz' WHEN 4 THEN 'Ropica Górna' WHEN 7 THEN 'Ruda Śląska' WHEN 0 THEN name END AS nominative FROM n""")
def h19_nominative(spark, sf_dir):
    """Names of places in the nominative; streets have none."""
    given = F.array(F.col("raw_obreb"), *map(F.lit, ("Frelichowie", "Zakopanem", "Nowym Sączu", "Ropica Górnaw", "Niedurnego", "Ofiar Września", "Rudzie-Śląskiej")), F.lit(None).cast("string"))
    rows = derived(spark, sf_dir, "fx_cases").select("listing_id", F.get(given, (F.col("listing_id") % 9).cast("int")).alias("name"))
    return rows.withColumn("nominative", t.nominative(F.col("name")))


@query("h20_infer_commune", f"{BASE}, {COMMUNE} SELECT * FROM inferred")
def h20_infer_commune(spark, sf_dir):
    """The commune of the city that each listing names, by runs of words."""
    x = tables(spark, sf_dir, named=True)
    return ops.infer_commune(x["listings"], ops.city_names(x["cities"], x["forms"]))


@query("c14_resolve_by_text_locality", f"{BASE}, {BY_TEXT} SELECT * FROM by_text")
def c14_resolve_by_text_locality(spark, sf_dir):
    """Listings resolved by a locality in an address of their text (C14)."""
    x = tables(spark, sf_dir)
    return ops.resolve_by_text_locality(x["listings"], x["cadastre"])


@query("c15_resolve_by_notice", f"{BASE}, {HINTS}, {BY_NOTICE} SELECT * FROM by_notice")
def c15_resolve_by_notice(spark, sf_dir):
    """Listings resolved by the numbers of their notices or of an override for their land register."""
    x = tables(spark, sf_dir)
    return ops.resolve_by_notice(x["listings"], x["notices"], x["cadastre"], x["overrides"])


@query("c16_resolve_by_city", f"{BASE}, {BY_CITY} SELECT * FROM by_city")
def c16_resolve_by_city(spark, sf_dir):
    """Listings resolved in the commune of the city that they name."""
    x = tables(spark, sf_dir, named=True)
    return ops.resolve_by_city(x["listings"], x["cadastre"], ops.city_names(x["cities"], x["forms"]))


@query("c17_resolve_by_unit", f"{BASE}, {BY_UNIT} SELECT * FROM by_unit")
def c17_resolve_by_unit(spark, sf_dir):
    """Listings resolved by a district unit and a precinct number (C17)."""
    x = tables(spark, sf_dir)
    return ops.resolve_by_unit(x["listings"], x["notices"], x["units"], x["cadastre"])


@query("c23_resolve_by_register", f"{BASE}, {BY_REGISTER} SELECT * FROM by_register")
def c23_resolve_by_register(spark, sf_dir):
    """Listings resolved by a regional register, where one row alone matches."""
    x = tables(spark, sf_dir)
    return ops.resolve_by_register(x["listings"], x["notices"], x["register"], x["rules"])


@query(
    "c19_resolve_cascade",
    f"""{BASE}, {BY_ID}, {BY_NAME}, {BY_TEXT}, {HINTS}, {BY_NOTICE}, {BY_UNIT}, {BY_REGISTER}, {BY_CITY},
b AS (SELECT *, 0 AS k FROM by_id UNION ALL SELECT *, 1 FROM by_name UNION ALL SELECT *, 2 FROM by_text UNION ALL SELECT *, 3 FROM by_notice UNION ALL SELECT *, 4 FROM by_unit UNION ALL SELECT *, 5 FROM by_register UNION ALL SELECT *, 6 FROM by_city),
r AS (SELECT DISTINCT listing_id, cad_id, method FROM b QUALIFY k = min(k) OVER (PARTITION BY listing_id)),
one AS (SELECT listing_id, cad_id FROM r QUALIFY count(*) OVER (PARTITION BY listing_id) = 1),
more AS (SELECT n.listing_id, n.cad_id, raw_kw FROM by_notice n JOIN one ON n.listing_id = one.listing_id AND n.cad_id <> one.cad_id JOIN l ON l.listing_id = n.listing_id WHERE regexp_matches(raw_text, 'dzia[łl]')),
m AS (SELECT listing_id, cad_id, CASE WHEN listing_id IN (SELECT listing_id FROM more WHERE raw_kw <> '') THEN 'kw_lookup' ELSE method END AS method FROM r),
f AS (SELECT * FROM m UNION ALL SELECT more.listing_id, more.cad_id, m.method FROM more JOIN m USING (listing_id))
SELECT listing_id, cad_id, method, CASE method WHEN 'teryt_exact' THEN 0.98 WHEN 'kw_lookup' THEN 0.92 WHEN 'uldk_partial' THEN 0.7 WHEN 'manual' THEN 0.7 END::DECIMAL(3,2) AS match_confidence,
  CASE WHEN cad_id IS NOT NULL THEN 'resolved' WHEN coalesce(raw_numer, '') = '' THEN 'missing_parcel_number' WHEN coalesce(raw_obreb, '') = '' THEN 'missing_precinct' ELSE 'not_found_or_ambiguous' END AS outcome FROM l LEFT JOIN f USING (listing_id)""",
)
def c19_resolve_cascade(spark, sf_dir):
    """Every listing with the parcels of the first of seven strategies that has any, joined by those of its notice, or the reason."""
    return ops.resolve_all(**tables(spark, sf_dir, named=True))
