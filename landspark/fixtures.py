"""Tables of parcels, zones, listings and signals derived from the driver's tables by integer arithmetic.

Every expression is valid in Spark and in DuckDB but for integer division, written ``//`` here and ``div`` in Spark, so a
query and its oracle read the same derived rows.  Derivations are projections (or one aggregation) of their base table, so
the work of a query grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def pick(index: str, *values: str | None) -> str:
    """A CASE over ``index`` from zero; ``None`` is null."""
    whens = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)) for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


def gmina(key: str, other: str) -> str:
    """A seven-digit commune code from two integer columns."""
    return f"concat({pick(f'{key} % 3', '12', '18', '24')}, lpad(cast({key} % 20 + 1 AS varchar(20)), 2, '0'), lpad(cast({key} % 9 + 1 AS varchar(20)), 2, '0'), cast({key} % 3 + 1 AS varchar(20)))"


SYMBOLS = ("MN", "19.MN", "U/MN-3", "MN.1", "1MNU", "MW/U.1", "ZL", "KD", "R", "ZP", "U", "MW", "P", "WS", "KDL", "ML")
USES = ("R", "Ł", "Ps", "Ls", "B", "Bp", None, "", "LS", "Bi")

PARCELS = f"""
SELECT o_orderkey AS parcel_id, 500000 + (o_orderkey * 7919 % 20011) AS x0, 300000 + (o_orderkey * 104729 % 20021) AS y0,
  20 + o_custkey % 60 AS w, 20 + o_orderkey % 50 AS h, cast(o_orderkey % 3 AS int) AS shape,
  cast({pick('o_orderkey % 4', 0.98, 0.92, 0.70, 0.55)} AS decimal(3,2)) AS match_confidence,
  {pick('o_orderkey % 10', *USES)} AS current_use, {gmina('o_custkey', 'o_custkey')} AS teryt_gmina, o_orderdate AS created_at
FROM orders
"""

ZONES = f"""
SELECT c_custkey AS zone_id, 500000 + (c_custkey * 6007 % 20011) AS x0, 300000 + (c_custkey * 9973 % 20021) AS y0,
  100 + c_custkey * 31 % 400 AS w, 100 + c_custkey * 17 % 300 AS h, cast(c_custkey % 3 AS int) AS shape,
  {pick('c_custkey % 16', *SYMBOLS)} AS symbol, {pick('c_custkey % 3', 'mpzp', 'pog', 'studium')} AS plan_type,
  concat('plan ', cast(c_custkey % 40 AS varchar(20))) AS plan_name, {gmina('c_custkey', 'c_custkey')} AS teryt_gmina
FROM customer
"""

ADJACENT = f"""
SELECT 1000000 + parcel_id AS zone_id, x0 + w AS x0, y0, cast(50 AS bigint) AS w, h, 0 AS shape, 'MN' AS symbol, 'mpzp' AS plan_type,
  'adjacent plan' AS plan_name, teryt_gmina
FROM ({PARCELS}) p WHERE parcel_id % 10 = 0
"""

LISTINGS = f"""
SELECT l_orderkey * 10 + l_linenumber AS listing_id, l_orderkey AS parcel_id, cast(max(l_extendedprice) AS decimal(14,2)) AS price_zl,
  max(l_shipdate) AS created_at,
  concat('https://example.test/', cast(l_orderkey * 10 + l_linenumber AS varchar(20)), {pick('(l_orderkey * 10 + l_linenumber) % 4', '-las', '-budowlane', '-rolna', '-mpzp')}) AS source_url
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

SIGNALS = f"""
SELECT event_id AS signal_id, {gmina('user_id', 'user_id')} AS teryt_gmina,
  CASE WHEN event_id % 5 = 0 THEN event_id // 5 END AS parcel_id,
  {pick('event_id % 6', 'pog_zone', 'pog_ouz', 'studium_zone', 'planning_resolution', 'mpzp_project', 'planning_resolution')} AS signal_kind,
  {pick('event_id % 4', 'formal_binding', 'formal_directional', 'formal_preparatory', 'heuristic')} AS signal_status,
  {pick('event_id % 12', 'residential', 'mixed_residential', 'service', 'residential', 'mixed_residential', 'forest', 'agricultural', 'unknown', None, 'service', 'industrial', 'residential')} AS designation_normalized,
  CASE WHEN event_id % 7 > 0 THEN concat('https://plan.test/', cast(event_id % 7 AS varchar(20)), '/', cast(user_id % 50 AS varchar(20))) END AS source_url,
  CASE WHEN event_id % 3 > 0 THEN concat('plan ', cast(event_id % 11 AS varchar(20))) END AS plan_name,
  {pick('event_id % 3', 'html', 'gison', 'pdf')} AS source_type, ts AS created_at
FROM events
"""

RETRY = f"""
SELECT event_id AS listing_id, cast(user_id % 5 + 1 AS int) AS attempt_count,
  {pick('event_id % 5', 'ULDK_NOT_FOUND: no parcel', 'GEOMETRY_MISSING: empty polygon', 'missing parcel number', 'no_source_configured', 'manual_review_required')} AS last_error,
  CASE WHEN event_id % 9 = 0 THEN 'użytkowanie wieczyste' WHEN event_id % 9 = 1 THEN 'Centrum' END AS raw_obreb,
  CASE WHEN event_id % 8 = 0 THEN '12a' ELSE cast(event_id % 300 AS varchar(20)) END AS raw_numer_dzialki, ts AS next_retry_at
FROM events WHERE event_type = 'error' OR event_id % 10 = 0
"""

NOTICES = f"""
SELECT listing_id, parcel_id, price_zl, concat('Komornik Km ', cast(listing_id % 900 + 1 AS varchar(20)), '/25. Działka nr ',
  cast(parcel_id % 999 + 1 AS varchar(20)), '/', cast(parcel_id % 9 + 1 AS varchar(20)), ', KW ', {pick('listing_id % 4', 'WA1M', 'GD4K', 'PO1P', 'KR1K')}, '/',
  lpad(cast(listing_id AS varchar(20)), 8, '0'), '/', cast(listing_id % 10 AS varchar(20)), '. Cena wywołania ', replace(cast(price_zl AS varchar(30)), '.', ','),
  ' zł, wadium 2 000 zł. Powierzchnia ', cast(200 + listing_id % 3000 AS varchar(20)), ' m2, 15.05.2026, gmina Skawina, powiat krakowski, woj. ',
  {pick('listing_id % 3', 'małopolskie', 'podkarpackie', 'śląskie')}, '.') AS text
FROM ({LISTINGS}) l
"""

LEADS = f"""
SELECT o_orderkey AS lead_id, o_orderkey // 2 AS parcel_id, {gmina('o_custkey', 'o_custkey')} AS teryt_gmina, {pick('o_orderkey % 3', 'current_buildable', 'future_buildable', 'current_buildable')} AS strategy_type,
  cast(cast(40 + o_orderkey * 7 % 61 AS decimal(10,2)) / 100 AS decimal(3,2)) AS confidence_score,
  CASE WHEN o_orderkey % 3 = 1 THEN {pick('o_custkey % 4', 'formal', 'supported', 'speculative', None)} END AS confidence_band,
  {pick('o_custkey % 5', 'new', 'reviewed', 'shortlisted', 'rejected', 'new')} AS status,
  CASE WHEN o_orderkey % 11 > 0 THEN cast(cast(o_orderkey * 37 % 10001 AS decimal(12,2)) / 100 AS decimal(5,2)) END AS max_coverage_pct,
  CASE WHEN o_orderkey % 13 > 0 THEN cast(o_custkey * 13 % 6000 AS decimal(12,2)) END AS max_buildable_area_m2,
  CASE WHEN o_orderkey % 17 > 0 THEN {pick('o_orderkey % 6', 'MN', 'MW/U', 'U', 'ZL', 'MNU', 'ML')} END AS dominant_przeznaczenie,
  CASE WHEN o_orderkey % 3 = 1 THEN {pick('o_custkey % 3', 'pog_zone: residential', 'planning_resolution: service', 'studium_zone: mixed_residential')} END AS dominant_future_signal,
  CASE WHEN o_orderkey % 7 > 0 THEN cast(100 + o_orderkey * 7919 % 400000 AS decimal(14,2)) END AS price_zl,
  cast(200 + o_custkey % 3000 AS decimal(12,2)) AS area_m2,
  CASE WHEN o_orderkey % 7 > 0 THEN cast(cast((100 + o_orderkey * 7919 % 400000) * 100 // (200 + o_custkey % 3000) AS decimal(14,2)) / 100 AS decimal(12,2)) END AS price_per_m2_zl,
  CASE WHEN o_orderkey % 3 = 1 THEN cast(o_custkey * 11 % 101 AS decimal(6,2)) END AS overall_score,
  CASE WHEN o_orderkey % 3 = 1 THEN cast(o_custkey * 11 % 81 AS decimal(6,2)) END AS future_signal_score,
  CASE WHEN o_orderkey % 3 = 1 THEN cast(o_custkey % 3 * 10 AS decimal(5,2)) END AS cheapness_score, o_orderdate AS created_at
FROM orders
"""

# the zones of plans that are loaded so far, and the leads that are still open: those of one market segment, and of the dearest orders
LOADED = f"{ZONES.rstrip()} WHERE c_mktsegment = 'BUILDING'\n"
OPEN_LEADS = f"{LEADS.rstrip()} WHERE o_totalprice > 490000\n"

CADASTRE = f"""
SELECT concat({gmina('o_custkey', 'o_custkey')}, '.', lpad(cast(o_orderkey % 30 + 1 AS varchar(20)), 4, '0'), '.', cast(o_orderkey % 211 + 1 AS varchar(20))) AS cad_id,
  {pick('o_custkey % 3', '12', '18', '24')} AS woj, concat('Obręb-', {pick('o_orderkey % 7', 'Łąki', 'Górny', 'Dolny', 'Śródmieście', 'Zachód', 'Wschód', 'Nowy')}, ' ', cast(o_orderkey % 41 AS varchar(20))) AS precinct_name,
  cast(o_orderkey % 211 + 1 AS varchar(20)) AS number, cast(200 + o_orderkey % 1500 AS decimal(12,2)) AS area_m2, o_orderkey AS k
FROM orders
"""

UNRESOLVED = f"""
SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 4 = 0 THEN concat({gmina('o_custkey', 'o_custkey')}, lpad(cast(o_orderkey % 30 + 1 AS varchar(20)), 2, '0'))
    WHEN o_orderkey % 4 < 3 THEN concat('OBRĘB ', {pick('o_orderkey % 7', 'łąki', 'górny', 'dolny', 'śródmieście', 'zachód', 'wschód', 'nowy')}, '  ', cast(o_orderkey % 41 AS varchar(20))) END AS raw_obreb,
  CASE WHEN o_orderkey % 9 > 0 THEN cast(o_orderkey % 211 + 1 AS varchar(20)) END AS raw_numer,
  CASE WHEN o_orderkey % 5 > 0 THEN {pick('o_custkey % 3', 'małopolskie', 'podkarpackie', 'śląskie')} END AS raw_woj,
  CASE WHEN o_orderkey % 6 > 0 THEN cast(210 + o_orderkey % 1500 AS decimal(12,2)) END AS area_m2
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
"""

# plots of a second cadastre, whose precincts have names without digits, and listings of nine kinds that are resolved to them
PRECINCT = f"""CASE WHEN o_custkey % 180 = 0 THEN concat({pick('o_orderkey % 30 % 4', 'NH', 'K', 'S', 'P')}, '-', cast(o_orderkey % 30 + 1 AS varchar(20)))
  ELSE concat({pick('o_orderkey % 30 % 7', 'Łąki', 'Górne', 'Dolne', 'Śródmieście', 'Zachodnie', 'Wschodnie', 'Nowe')}, ' Wol', chr(cast(97 + (o_custkey % 20 + o_custkey % 9 + o_orderkey % 30) % 25 AS int))) END"""
CITY = f"concat({pick('o_custkey % 9 % 5', 'Nowy ', 'Stary ', 'Wielki ', '', 'Górny ')}, {pick('o_custkey % 20 % 10', 'Sącz', 'Targ', 'Dwór', 'Staw', 'Gród', 'Młyn', 'Most', 'Bór', 'Brzeg', 'Port')})"
FIRST, SECOND, THIRD, REGION = "cast(o_orderkey % 211 + 1 AS varchar(20))", "cast(o_orderkey * 7 % 211 + 1 AS varchar(20))", "cast(o_orderkey * 3 % 211 + 1 AS varchar(20))", "cast(o_orderkey % 30 + 1 AS varchar(20))"

PLOTS = f"""
SELECT concat({gmina('o_custkey', 'o_custkey')}, '.', lpad({REGION}, 4, '0'), '.', {FIRST}) AS cad_id, {gmina('o_custkey', 'o_custkey')} AS commune, lpad({REGION}, 4, '0') AS region_code, {PRECINCT} AS region_name,
  {FIRST} AS number, {pick('o_custkey % 3', '12', '18', '24')} AS woj, cast(200 + o_orderkey % 1500 AS decimal(12,2)) AS area_m2, {CITY} AS commune_name, o_orderkey AS k
FROM orders
"""

CITIES = f"""
SELECT name, min(commune) AS commune FROM (SELECT {CITY} AS name, {gmina('o_custkey', 'o_custkey')} AS commune FROM orders) c GROUP BY name, substr(commune, 1, 2)
"""

CASES = f"""
SELECT o_orderkey AS listing_id, {pick('o_orderkey % 9', 'ID', 'NAME', 'Urząd', 'PLAIN', None, None, None, None, 'PLAIN')} AS kind, o_orderkey % 9 AS form,
  CASE o_orderkey % 9 WHEN 0 THEN concat({gmina('o_custkey', 'o_custkey')}, lpad({REGION}, 2, '0')) WHEN 1 THEN concat(lpad({REGION}, 4, '0'), ' ', upper({PRECINCT})) WHEN 2 THEN 'Urząd' WHEN 3 THEN {PRECINCT} WHEN 8 THEN {PRECINCT} END AS raw_obreb,
  CASE WHEN o_orderkey % 9 IN (0, 1, 2, 6, 7) THEN {FIRST} WHEN o_orderkey % 9 = 8 THEN '' END AS raw_numer,
  CASE WHEN o_orderkey % 5 > 0 THEN {pick('o_custkey % 3', 'małopolskie', 'podkarpackie', 'śląskie')} END AS raw_woj, CASE WHEN o_orderkey % 9 = 5 THEN {CITY} END AS raw_gmina,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('KW ', cast(o_orderkey AS varchar(20))) END AS raw_kw, CASE WHEN o_orderkey % 6 > 0 THEN cast(210 + o_orderkey % 1500 AS decimal(12,2)) END AS area_m2, 'Licytacja' AS title,
  CASE o_orderkey % 9 WHEN 1 THEN 'grunt i działki' WHEN 2 THEN concat('Nieruchomość. Adres nieruchomości 33-250 ', {PRECINCT}, ', poczta Lisia. Komornik Sądowy')
    WHEN 6 THEN concat('działka nr ', {FIRST}, ' położona w ', {CITY}, 'u, obręb ', {REGION})
    WHEN 7 THEN concat('działka nr ', {FIRST}, ' w miejscowości ', {CITY}, 'u, ', CASE WHEN o_orderkey % 2 = 0 THEN {PRECINCT} ELSE 'teren' END, ' Komornik Sądowy w mieście Port') ELSE 'działka' END AS raw_text
FROM orders
"""

ENRICHED = f"""
SELECT o_orderkey AS listing_id, {FIRST} AS number_1, {SECOND} AS number_2,
  CASE WHEN o_orderkey % 9 = 4 THEN concat('działki nr ', {FIRST}, ', ', {SECOND}, ', jedn. ewid. ', {pick('o_orderkey % 30 % 4', 'Nowa Huta', 'Krowodrza', 'Śródmieście', 'Podgórze')}, ', obręb ', {REGION}) END AS text
FROM orders WHERE o_orderkey % 9 IN (1, 3, 4, 5)
"""

OVERRIDES = f"""
SELECT concat('KW', cast(o_orderkey AS varchar(20))) AS kw, {THIRD} AS number, {PRECINCT} AS obreb FROM orders WHERE o_orderkey % 36 = 12
"""

SQL = {"fx_cadastre": CADASTRE, "fx_unresolved": UNRESOLVED, "fx_leads": LEADS, "fx_parcels": PARCELS, "fx_zones": ZONES, "fx_zones_adjacent": ADJACENT, "fx_loaded": LOADED, "fx_open_leads": OPEN_LEADS, "fx_listings": LISTINGS, "fx_signals": SIGNALS, "fx_retry": RETRY, "fx_notices": NOTICES, "fx_plots": PLOTS, "fx_cities": CITIES, "fx_cases": CASES, "fx_enriched": ENRICHED, "fx_overrides": OVERRIDES}
BASE = {"fx_cadastre": "orders", "fx_unresolved": "orders", "fx_leads": "orders", "fx_parcels": "orders", "fx_zones": "customer", "fx_zones_adjacent": "orders", "fx_loaded": "customer", "fx_open_leads": "orders", "fx_listings": "lineitem", "fx_signals": "events", "fx_retry": "events", "fx_notices": "lineitem", "fx_plots": "orders", "fx_cities": "orders", "fx_cases": "orders", "fx_enriched": "orders", "fx_overrides": "orders"}

#: Vertices of a ring, clockwise and not closed, for the three shapes.
RECTANGLE = ("x0, y0", "x0, y0 + h", "x0 + w, y0 + h", "x0 + w, y0")
L_SHAPE = ("x0, y0", "x0, y0 + h", "x0 + w - w // 2, y0 + h", "x0 + w - w // 2, y0 + h - h // 2", "x0 + w, y0 + h - h // 2", "x0 + w, y0")
TRIANGLE = ("x0, y0", "x0, y0 + h", "x0 + w, y0")


#: Rows of a base table, about, that one task groups.
GROUPED_ROWS = 500_000


def spark_sql(text: str) -> str:
    return text.replace("//", "div").replace("https:div", "https://")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name``; polygon tables also get their ``geom`` column."""
    base = spark.read.parquet(f"{sf_dir}/{BASE[name]}.parquet")
    if BASE[name] == "lineitem":  # grouped by order and line: tasks get a bounded number of rows, for rows of keys are many in few shuffled bytes
        base = base.repartition(max(spark.sparkContext.defaultParallelism, base.count() // GROUPED_ROWS + 1), "l_orderkey")
    text = re.sub(rf"\bFROM {BASE[name]}\b", "FROM {base}", spark_sql(SQL[name]))
    df = spark.sql(text, base=base)
    return with_ring(df) if "shape" in df.columns else df


def with_ring(df: DataFrame) -> DataFrame:
    """``geom`` as polygon -> ring -> vertex from the box and shape columns."""
    ring = lambda points: "array(" + ", ".join("named_struct('x', cast({} AS double), 'y', cast({} AS double))".format(*p.split(", ")) for p in points) + ")"
    return df.selectExpr("*", spark_sql(f"array(array(CASE shape WHEN 0 THEN {ring(RECTANGLE)} WHEN 1 THEN {ring(L_SHAPE)} ELSE {ring(TRIANGLE)} END)) AS geom"))


def duck(*names: str) -> str:
    """CTEs of derived tables for an oracle, without WITH."""
    return ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def duck_edges(name: str, table: str, key: str) -> str:
    """A CTE of directed edges (key, x1, y1, x2, y2) of a derived polygon table."""
    ring = lambda points: "[" + ", ".join("[({})::DOUBLE, ({})::DOUBLE]".format(*p.split(", ")) for p in points) + "]"
    rings = f"CASE shape WHEN 0 THEN {ring(RECTANGLE)} WHEN 1 THEN {ring(L_SHAPE)} ELSE {ring(TRIANGLE)} END"
    return f"""{name}_r AS (SELECT {key}, {rings} AS r FROM {table}),
{name} AS (SELECT {key}, r[i][1] AS x1, r[i][2] AS y1, r[i % len(r) + 1][1] AS x2, r[i % len(r) + 1][2] AS y2
  FROM (SELECT {key}, r, unnest(range(1, len(r) + 1)) AS i FROM {name}_r))"""
