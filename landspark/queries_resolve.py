"""Registered queries of the resolution of notices to parcels."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck
from landspark.operators import resolve as ops
from landspark.queries import query

KEY = "trim(regexp_replace(translate(lower({0}), 'ąćęłńóśźż', 'acelnoszz'), '[\\s\\-]+', ' ', 'g'))"
BASE = f"WITH {duck('fx_cadastre', 'fx_unresolved')}, cad AS (SELECT * FROM fx_cadastre QUALIFY row_number() OVER (PARTITION BY cad_id ORDER BY k) = 1)"
BY_ID = f"""{BASE}, by_id AS (SELECT listing_id, cad_id, 'teryt_exact' AS method FROM (SELECT listing_id, substr(raw_obreb, 1, 7) || '.' || lpad(substr(raw_obreb, 8, 2), 4, '0') || '.' || raw_numer AS cad_id FROM fx_unresolved WHERE regexp_full_match(raw_obreb, '\\d{{9}}')) SEMI JOIN cad USING (cad_id))"""
BY_NAME = f"""{BY_ID}, f AS (SELECT u.listing_id, u.area_m2, c.cad_id, c.area_m2 AS ca, c.woj IS NOT DISTINCT FROM CASE u.raw_woj WHEN 'małopolskie' THEN '12' WHEN 'podkarpackie' THEN '18' WHEN 'śląskie' THEN '24' END AS here
  FROM fx_unresolved u JOIN cad c ON {KEY.format('u.raw_obreb')} = {KEY.format('c.precinct_name')} AND u.raw_numer = c.number),
g AS (SELECT *, count(*) OVER w AS n, count_if(here) OVER w AS nh FROM f WINDOW w AS (PARTITION BY listing_id)),
h AS (SELECT *, coalesce((nh = 0 OR here) AND ca BETWEEN area_m2 * 0.95 AND area_m2 * 1.05 AND area_m2 > 0, FALSE) AS near FROM g),
i AS (SELECT *, count_if(near) OVER (PARTITION BY listing_id) AS nn FROM h),
by_name AS (SELECT listing_id, cad_id, CASE WHEN n = 1 OR (nh = 1 AND here) THEN 'teryt_exact' ELSE 'uldk_partial' END AS method FROM i WHERE n = 1 OR (nh = 1 AND here) OR (n > 1 AND nh <> 1 AND nn = 1 AND near))"""


def tables(spark, sf_dir):
    from landspark.operators.tables import newest

    return derived(spark, sf_dir, "fx_unresolved"), newest(derived(spark, sf_dir, "fx_cadastre"), ["cad_id"], [F.asc("k")])


@query("c12_resolve_by_id", f"{BY_ID} SELECT * FROM by_id")
def c12_resolve_by_id(spark, sf_dir):
    """Listings resolved by a code that makes a canonical id."""
    return ops.resolve_by_id(*tables(spark, sf_dir))


@query("c13_resolve_by_name", f"{BY_NAME} SELECT * FROM by_name")
def c13_resolve_by_name(spark, sf_dir):
    """Listings resolved by precinct name and number, with province and area tie-breaks."""
    return ops.resolve_by_name(*tables(spark, sf_dir))


@query(
    "c18_common_region",
    """WITH c AS (SELECT DISTINCT l_orderkey AS notice_id, l_linenumber AS number, (l_partkey * l_linenumber) % 4 AS region_code FROM lineitem),
n AS (SELECT notice_id, count(DISTINCT number) AS k FROM c GROUP BY notice_id HAVING count(DISTINCT number) > 1),
v AS (SELECT notice_id, region_code, count(*) AS votes, k FROM c JOIN n USING (notice_id) GROUP BY notice_id, region_code, k),
t AS (SELECT notice_id, count_if(votes = k) AS common, min(CASE WHEN votes = k THEN region_code END) AS one, max(votes) AS top FROM v GROUP BY notice_id),
s AS (SELECT notice_id, common, one, t.top, count_if(votes = t.top) AS tops, min(CASE WHEN votes = t.top THEN region_code END) AS best FROM t JOIN v USING (notice_id) GROUP BY ALL)
SELECT notice_id, CASE WHEN common = 1 THEN one WHEN top >= 3 AND tops = 1 THEN best END AS region_code FROM s WHERE common = 1 OR (top >= 3 AND tops = 1)""",
)
def c18_common_region(spark, sf_dir):
    """The precinct that a notice's parcels share, by intersection or majority."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return ops.infer_common_region(lines.select(F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("number"), ((F.col("l_partkey") * F.col("l_linenumber")) % 4).alias("region_code")))


@query("k2_run_future")
def k2_run_future(spark, sf_dir):
    """Future-buildability assessments of all parcels (K2); its parts have SQL of their own."""
    from landspark.plans.future import run_future
    from landspark.queries_tables import i11_buildable_status

    zones = derived(spark, sf_dir, "fx_zones")
    beside = derived(spark, sf_dir, "fx_zones_adjacent").select(*zones.columns)
    statuses = i11_buildable_status(spark, sf_dir).withColumnRenamed("status", "current_buildable_status")
    return run_future(derived(spark, sf_dir, "fx_parcels"), zones.unionByName(beside), derived(spark, sf_dir, "fx_signals"), derived(spark, sf_dir, "fx_listings"), statuses).select("parcel_id", "future_signal_score", "cheapness_score", "overall_score", "heuristic_hits", "confidence_band")
