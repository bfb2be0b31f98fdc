"""The future-buildability plan: signals, spatial heuristics and prices to a score and a band for each parcel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.functions import planning as p
from landspark.operators import signals as s
from landspark.operators.spatial import least_distances, shared_boundary

#: The farthest distance, in metres, that any rule looks at.
REACH = 100.0


def per_m2() -> Column:
    """Price per square metre, rounded half-even to two places, as it is stored; null without a price or an area."""
    return F.bround(F.try_divide(F.col("price_zl").cast("double"), F.col("area_m2")), 2)


def heuristics(parcels: DataFrame, zones: DataFrame) -> DataFrame:
    """Distances and contacts of each parcel, from one join for the least distances to zones within reach and one boundary join.

    Distances beyond the reach are null, which no rule tells from a larger number.
    """
    symbol = F.col("symbol")
    kinds = {"distance_to_nearest_buildable_m": p.is_buildable(symbol), "distance_to_mixed_service_zone_m": p.is_mixed(symbol), "distance_to_meaningful_road_m": p.is_road(symbol)}
    found = least_distances(parcels, zones, "parcel_id", "zone_id", REACH, kinds).withColumnRenamed("left_id", "parcel_id")
    edge = shared_boundary(parcels, zones.filter(p.is_buildable(F.col("symbol"))), "parcel_id", "zone_id").select(F.col("left_id").alias("parcel_id"), "shared_boundary_m", F.col("adjacent_pct").alias("adjacent_buildable_pct"))
    out = parcels.select("parcel_id").join(found, "parcel_id", "left").join(edge, "parcel_id", "left")
    return out.withColumn("has_road_access_signal", F.coalesce(F.col("distance_to_meaningful_road_m") <= 30, F.lit(False))).withColumn("has_urban_cluster_signal", F.coalesce(F.col("distance_to_nearest_buildable_m") <= REACH, F.lit(False)))


def run_future(parcels: DataFrame, zones: DataFrame, signals: DataFrame, listings: DataFrame, statuses: DataFrame) -> DataFrame:
    """Assessments of all parcels; ``signals`` of parcels and of whole communes, ``statuses`` (parcel_id, current_buildable_status).

    Each per-parcel question is one join over the whole table.
    """
    area = parcels.select("parcel_id", "teryt_gmina", g.area(F.col("geom")).alias("area_m2"))
    latest = listings.groupBy("parcel_id").agg(F.max_by("price_zl", F.struct("created_at", "listing_id")).alias("price_zl"))
    priced = area.join(latest, "parcel_id", "left").withColumn("price_per_m2", per_m2())
    benchmark = s.market_benchmark(listings.join(area, "parcel_id").select("teryt_gmina", per_m2().alias("price_per_m2")))
    rows = s.with_benchmark(priced, benchmark)
    rows = rows.withColumn("cheapness_score", p.cheapness(F.col("price_per_m2"), F.coalesce("sample_size", F.lit(0)), F.col("p25"), F.col("p40")))
    rows = rows.join(s.score_signals(parcels, signals), "parcel_id", "left").join(s.corroborate(parcels, signals).select("parcel_id", "bonus"), "parcel_id", "left")
    rows = rows.join(heuristics(parcels, zones), "parcel_id").join(statuses, "parcel_id")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    points = F.coalesce("signal_score", F.lit(0)) + F.coalesce("bonus", F.lit(0)) + p.heuristic_bonus()
    out = rows.select(
        "parcel_id", "teryt_gmina", "price_per_m2", "scope", "cheapness_score", "current_buildable_status", flag("has_formal_signal"), flag("has_supporting_formal_signal"), flag("hard_negative"),
        F.col("bonus").isNotNull().alias("has_corroborated_supporting_signal"), F.col("dominant_signal"), p.heuristic_hits().alias("heuristic_hits"), F.lit(False).alias("dominant_unknown_resolution"),
        F.least(F.lit(100), F.greatest(F.lit(0), points)).cast("decimal(6,2)").alias("future_signal_score"),
    )
    out = out.withColumn("overall_score", F.least(F.lit(100), F.col("future_signal_score") + F.col("cheapness_score")).cast("decimal(6,2)"))
    return out.withColumn("confidence_band", p.confidence_band())
