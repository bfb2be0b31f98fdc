"""Overrides: outcomes, repeated decisions, and versions that are seen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from landspark import storage
from landspark.operators import override as ops

GEOM = "array<array<array<struct<x: double, y: double>>>>"
ZONES = f"zone_id string, source string, teryt_gmina string, symbol string, plan_type string, plan_name string, resolution string, geom {GEOM}"
DELTAS = "parcel_id long, zone_id string, coverage_pct decimal(5,2), intersection_area_m2 decimal(12,2), use_before string, symbol string, delta_score decimal(3,2)"
LEADS = "parcel_id long, zone_id string, confidence_score decimal(3,2), priority string, dominant_przeznaczenie string, price_per_m2_zl decimal(12,2)"
SQUARE = [[[(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]]]


def given(spark):
    parcels = spark.createDataFrame([(i, "1261011", "B", 0.98, SQUARE) for i in (1, 2, 3)], f"parcel_id long, teryt_gmina string, current_use string, match_confidence double, geom {GEOM}").withColumn("match_confidence", F.col("match_confidence").cast("decimal(3,2)"))
    listings = spark.createDataFrame([(1, 10, 5000, "2026-01-01"), (1, 11, 7000, "2026-01-02")], "parcel_id long, listing_id long, price_zl int, created_at string").withColumn("price_zl", F.col("price_zl").cast("decimal(14,2)"))
    decisions = spark.createDataFrame([(1, "ZL", 1), (1, "19.MN", 2), (2, "U", 1), (3, "R", 1), (9, "MN", 1), (None, "MN", 1), (3, None, 0)], "parcel_id long, symbol string, decided_at int")
    tables = {"zones": spark.createDataFrame([], ZONES), "deltas": spark.createDataFrame([(1, "manual:1:U", 100, 100, None, "U", 0), (1, "z7", 50, 50, None, "U", 0)], "parcel_id long, zone_id string, coverage_pct int, intersection_area_m2 int, use_before string, symbol string, delta_score int").selectExpr(*(f"cast({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in DELTAS.split(", "))), "leads": spark.createDataFrame([(2, "z1", None, None, None, None)], LEADS)}
    return parcels, listings, decisions, tables


def test_outcomes_and_rows(spark):
    parcels, listings, decisions, tables = given(spark)
    judged = ops.judge(decisions, parcels, tables["leads"])
    assert {r.parcel_id: (r.symbol, r.outcome) for r in judged.collect()} == {1: ("19.MN", "accepted"), 2: ("U", "has_lead"), 3: ("R", "not_buildable"), 9: ("MN", "no_parcel")}
    after = ops.override(tables, parcels, listings, judged)
    assert [(r.zone_id, r.resolution, len(r.geom[0][0])) for r in after["zones"].collect()] == [("manual:1:MN", ops.RESOLUTION, 4)]
    assert sorted((r.parcel_id, r.zone_id, float(r.coverage_pct)) for r in after["deltas"].collect()) == [(1, "manual:1:MN", 100.0), (1, "z7", 50.0)]
    lead = next(r for r in after["leads"].collect() if r.parcel_id == 1)
    assert (float(lead.confidence_score), lead.priority, lead.dominant_przeznaczenie, float(lead.price_per_m2_zl)) == (0.93, "high", "19.MN", 70.0)
    # once more, for a parcel whose lead was taken away again: nothing is doubled
    again = ops.override({**after, "leads": tables["leads"]}, parcels, listings, judged)
    assert again["zones"].count() == 1 and again["deltas"].count() == 2 and again["leads"].count() == 2


def test_versions_are_whole(spark, tmp_path):
    parcels, listings, decisions, tables = given(spark)
    root = f"file://{tmp_path}/v"
    assert storage.published(spark, root) == {}
    assert storage.publish(tables, root) == 1
    after = ops.override(tables, parcels, listings, ops.judge(decisions, parcels, tables["leads"]))
    broken = {**after, "leads": after["leads"].withColumn("priority", F.raise_error(F.lit("lost")).cast("string"))}
    with pytest.raises(Exception, match="lost"):
        storage.publish(broken, root)
    # zones and deltas of the second version are on disk, but readers see the first one
    seen = storage.published(spark, root)
    assert storage.last_version(spark, root) == 1 and seen["zones"].count() == 0 and seen["deltas"].count() == 2
    assert storage.publish(after, root) == 2
    seen = storage.published(spark, root)
    assert seen["zones"].count() == 1 and ops.stale({**seen, "deltas": seen["deltas"].filter("zone_id <> 'z7'")}).count() == 0
    assert storage.published(spark, root, 1)["zones"].count() == 0
