"""Manual zoning overrides: an analyst's decision becomes a zone, a delta and a lead, which are published together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.functions import planning as p
from landspark.plans.delta import leads as make_leads

# fixed values: how a zone of a decision is named
SOURCE, PLAN_NAME, RESOLUTION = "manual://quarantine", "Manual override (kwarantanna)", "MANUAL_OVERRIDE"


def judge(decisions: DataFrame, parcels: DataFrame, leads: DataFrame) -> DataFrame:
    """(parcel_id, symbol, outcome) of each parcel decided on: not_buildable, no_parcel, has_lead or accepted.

    Of several decisions on a parcel the latest counts (decided_at, then the symbol).  Decisions without a parcel_id are left out.
    """
    last = decisions.filter("parcel_id IS NOT NULL").groupBy("parcel_id").agg(F.max_by("symbol", F.struct("decided_at", "symbol")).alias("symbol"))
    known = parcels.select("parcel_id").distinct().withColumn("_known", F.lit(True))
    led = leads.select("parcel_id").distinct().withColumn("_led", F.lit(True))
    rows = last.withColumn("symbol", F.trim("symbol")).join(known, "parcel_id", "left").join(led, "parcel_id", "left")
    outcome = F.when(~F.coalesce(p.is_buildable(F.col("symbol")), F.lit(False)), "not_buildable").when(F.col("_known").isNull(), "no_parcel").when(F.col("_led"), "has_lead").otherwise("accepted")
    return rows.select("parcel_id", "symbol", outcome.alias("outcome"))


def override(tables: dict[str, DataFrame], parcels: DataFrame, listings: DataFrame, judged: DataFrame) -> dict[str, DataFrame]:
    """The tables zones, deltas and leads with what accepted decisions add.

    A decision's zone is its parcel's polygon, keyed by parcel and symbol, so a repeated decision changes nothing; earlier manual deltas
    of the parcel go; the delta covers it wholly, whatever its use; the lead is that of the delta plan.  zones: zone_id (text), source, teryt_gmina, symbol,
    plan_type, plan_name, resolution, geom; deltas: parcel_id, zone_id, coverage_pct, intersection_area_m2, use_before, symbol, delta_score; leads have the columns of
    ``delta.leads``.
    """
    yes = judged.filter("outcome = 'accepted'").select("parcel_id", "symbol").join(parcels, "parcel_id")
    area = g.area(F.col("geom")).cast("decimal(12,2)")
    yes = yes.withColumn("zone_id", F.concat_ws(":", F.lit("manual"), F.col("parcel_id").cast("string"), p.normalise_symbol(F.col("symbol")))).withColumn("area_m2", area)
    full = F.lit(100).cast("decimal(5,2)")
    zone = yes.select("zone_id", F.lit(SOURCE).alias("source"), "teryt_gmina", "symbol", F.lit("mpzp").alias("plan_type"), F.lit(PLAN_NAME).alias("plan_name"), F.lit(RESOLUTION).alias("resolution"), "geom")
    delta = yes.select("parcel_id", "zone_id", full.alias("coverage_pct"), F.col("area_m2").alias("intersection_area_m2"), F.col("current_use").alias("use_before"), "symbol", p.delta_score(full).alias("delta_score"))
    found = yes.select(
        "parcel_id", "zone_id", full.alias("coverage_pct"), F.col("area_m2").alias("intersection_area_m2"), "match_confidence", F.lit(None).cast("string").alias("current_use"), "teryt_gmina", "area_m2", "symbol",
        F.lit("mpzp").alias("plan_type"), F.lit(PLAN_NAME).alias("plan_name"),
    )
    found = found.withColumn("qualifies", p.qualifies(F.col("symbol"), F.col("current_use"), F.col("coverage_pct"), F.col("intersection_area_m2")))
    manual = F.startswith("zone_id", F.lit("manual:"))
    old = tables["deltas"].join(yes.select("parcel_id", F.lit(True).alias("_hit")), "parcel_id", "left").filter(~(F.coalesce("_hit", F.lit(False)) & manual)).drop("_hit")
    lead = make_leads(found, listings)
    return {
        "zones": tables["zones"].join(zone.select("zone_id"), "zone_id", "left_anti").unionByName(zone.select(tables["zones"].columns)),
        "deltas": old.unionByName(delta.select(tables["deltas"].columns)),
        "leads": tables["leads"].unionByName(lead.select(tables["leads"].columns)),
    }


def stale(tables: dict[str, DataFrame]) -> DataFrame:
    """Deltas without their zone, and manual leads without their delta: none in a consistent version."""
    lost = tables["deltas"].join(tables["zones"].select("zone_id"), "zone_id", "left_anti").select("parcel_id", F.lit("delta without zone").alias("fault"))
    manual = tables["leads"].filter(F.startswith("zone_id", F.lit("manual:")))
    return lost.union(manual.join(tables["deltas"].select("parcel_id", "zone_id"), ["parcel_id", "zone_id"], "left_anti").select("parcel_id", F.lit("lead without delta")))
