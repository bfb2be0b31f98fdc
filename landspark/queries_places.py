"""Registered queries of parcel numbers, places and precincts, over notices in six forms derived from the notices' columns."""

from __future__ import annotations

from landspark.fixtures import derived, duck, pick
from landspark.operators import places as ops
from landspark.queries import query

NUMBER = "concat(cast(parcel_id % 999 + 1 AS varchar(20)), '/', cast(parcel_id % 9 + 1 AS varchar(20)))"
PLACE = pick("listing_id % 5", "Stregoborzyce", "Frelichów", "Szopienice", "Lasek", "Zwonowice")
FORMS = f"""CASE listing_id % 6
  WHEN 0 THEN concat('dzialka nr ', {NUMBER}, ' o pow. 0,88 HA, pol. w ', {PLACE})
  WHEN 1 THEN concat('dz. nr ', {NUMBER}, ' 32-125 ', {PLACE}, ' Komornik Sadowy')
  WHEN 2 THEN concat('działkę gruntu oznaczoną numerem ewidencyjnym ', {NUMBER}, ' (ob. 0006, ', {PLACE}, '; KW: KA1K/00098017/7)')
  WHEN 3 THEN concat('udział ', {NUMBER}, ' części, sygn. Km ', {NUMBER}, ', nieruchomość gruntowa w ', upper({PLACE}), ', objęta KW')
  WHEN 4 THEN concat('kod 1261011.0001.', {NUMBER})
  ELSE concat('jednostka 126101102, dz. ', {NUMBER}) END"""
ROWS = f"WITH {duck('fx_notices')}, n AS (SELECT listing_id AS doc_id, listing_id % 6 AS form, {NUMBER} AS number, {PLACE} AS place FROM fx_notices)"


def _notices(spark, sf_dir):
    return derived(spark, sf_dir, "fx_notices").selectExpr("listing_id", f"{FORMS} AS text")


@query(
    "h4_extract_parcels",
    f"""{ROWS} SELECT doc_id, number, CASE form WHEN 4 THEN '0001' WHEN 5 THEN NULL ELSE place END AS precinct_raw, CASE form WHEN 4 THEN '126101100' END AS precinct_code,
  (CASE form WHEN 2 THEN 0.67 WHEN 4 THEN 0.88 WHEN 5 THEN 0.72 ELSE 0.80 END)::DOUBLE AS confidence, CASE form WHEN 2 THEN 'bare' WHEN 4 THEN 'dotted_code' ELSE 'keyword' END AS source FROM n WHERE form <> 3""",
)
def h4_extract_parcels(spark, sf_dir):
    """Parcel numbers of notices with their places; numbers of cases and shares are none (H4, H5, H7)."""
    return ops.extract_parcels(_notices(spark, sf_dir), "listing_id").select("doc_id", "number", "precinct_raw", "precinct_code", "confidence", "source")


@query(
    "h6_extract_localities",
    f"""{ROWS} SELECT doc_id, place AS name, ['context', 'postal_code', 'obreb_abbrev', 'property_context'][form + 1] AS source, ([0.68, 0.74, 0.88, 0.78][form + 1])::DOUBLE AS confidence FROM n WHERE form < 4""",
)
def h6_extract_localities(spark, sf_dir):
    """Places that notices name, with the hint that found each (H6)."""
    return ops.extract_localities(_notices(spark, sf_dir), "listing_id").select("doc_id", "name", "source", "confidence")


@query("h8_extract_precinct", f"{ROWS} SELECT doc_id, CASE WHEN form < 4 THEN place WHEN form = 5 THEN '126101102' END AS precinct_raw, CASE WHEN form = 5 THEN '126101102' END AS precinct_code FROM n")
def h8_extract_precinct(spark, sf_dir):
    """The precinct of every notice (H8)."""
    return ops.extract_precinct(_notices(spark, sf_dir), "listing_id")
