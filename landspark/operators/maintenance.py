"""Quarantine lists, follow-up messages, saving of resolved parcels and of assessments, and small column rules of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a listing's address says for or against a parcel, and how much; the public register's search page
HINTS = {
    "warunkami-zabudowy": 45.0, "inwestycyjne": 35.0, "budowlane": 30.0, "widokowe": 12.0, "mpzp": 15.0, "niezabudowane": 8.0,
    "rolna": -35.0, "las": -30.0, "zalesien": -30.0, "udzial": -20.0,
}
NO_PLAN = ("uncovered_gmina", "Brak pokrycia MPZP dla gminy")
NO_LEAD = ("review_required", "Dzialka bez wygenerowanego leada")
REGISTER_SEARCH = "https://ekw.ms.gov.pl/eukw_ogol/KsiegiWieczyste"


def quarantine(parcels: DataFrame, leads: DataFrame, zones: DataFrame, listings: DataFrame, uncovered_only: bool = False) -> DataFrame:
    """Parcels without a lead, with reason, status and their newest listing's address; ``uncovered_only``: of communes without zones.

    Two anti or semi joins on keys and one aggregate a parcel; nothing is sorted.
    """
    covered = zones.select("teryt_gmina").distinct().withColumn("_covered", F.lit(True))
    newest = listings.groupBy("parcel_id").agg(F.max_by("source_url", F.struct("created_at", "listing_id")).alias("source_url"))
    rows = parcels.join(leads.select("parcel_id").distinct(), "parcel_id", "left_anti").join(covered, "teryt_gmina", "left").join(newest, "parcel_id", "left")
    rows = rows.withColumn("has_planning_zones", F.coalesce("_covered", F.lit(False))).drop("_covered")
    rows = rows.filter(~F.col("has_planning_zones")) if uncovered_only else rows
    either = lambda i: F.when(F.col("has_planning_zones"), NO_LEAD[i]).otherwise(NO_PLAN[i])
    return rows.withColumn("status", either(0)).withColumn("reason", either(1))


def hint_score(url: Column) -> Column:
    """The sum of what the words in an address say."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return sum((F.when(F.contains(low, F.lit(word)), value).otherwise(0.0) for word, value in HINTS.items()), F.lit(0.0))


def quarantine_candidates(rows: DataFrame, limit: int, tokens: list[str] | None = None) -> DataFrame:
    """The ``limit`` quarantined parcels whose addresses promise most, of those whose address holds one of ``tokens``."""
    scored = rows.withColumn("score", hint_score(F.col("source_url")))
    if tokens:
        scored = scored.filter(F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower("source_url"), F.lower(t))))
    return scored.orderBy(F.desc("score"), "parcel_id").limit(limit)


def sync_followups(report: DataFrame) -> DataFrame:
    """A message for every commune whose sync went well and brought nothing; ``report``: teryt, label, status, upserted."""
    quiet = report.filter("status = 'ok' AND coalesce(upserted, 0) = 0")
    return quiet.select("teryt", F.format_string("sync_zero_features:%s:%s -> needs_manual_probe", "teryt", "label").alias("message"))


def snippet(text: Column, offset: Column, length: Column, radius: int = 40) -> Column:
    """The text from ``radius`` characters before a match to as many behind it; ``offset`` counts from 0."""
    begin = F.greatest(offset - radius, F.lit(0))
    return F.replace(F.trim(F.substring(text, begin + 1, offset + length + radius - begin)), F.lit("\n"), F.lit(" "))


def register_link(number: Column) -> Column:
    """The public register's search page for a canonical number; null of anything else."""
    return F.when(F.trim(number).rlike(r"^[A-Z]{2}\d[A-Z]/\d{8}/\d$"), F.lit(REGISTER_SEARCH))


def pixel_of(x: Column, y: Column, bbox: tuple[float, float, float, float], width: int, height: int) -> tuple[Column, Column]:
    """Column and row of the pixel of a point in a picture of the box, the first row on top; outside it, the nearest one."""
    minx, miny, maxx, maxy = bbox
    if maxx <= minx or maxy <= miny:
        raise ValueError(f"no box: {bbox}")
    place = lambda share, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(share * (n - 1)).cast("int")))
    return place((x - minx) / (maxx - minx), width), place((maxy - y) / (maxy - miny), height)


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` put in, or in the place of those with the same keys; keys are unique in either."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` whose keys it lacks, once each."""
    return current.unionByName(new.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def clear_resolved(queue: DataFrame, links: DataFrame) -> DataFrame:
    """The retry queue without the listings that have a parcel now."""
    return queue.join(links.select("listing_id").distinct(), "listing_id", "left_anti")


def refresh_future_leads(current: DataFrame, assessed: DataFrame) -> DataFrame:
    """Future leads after an assessment: of the parcels assessed, those with a band have their new row, the others none."""
    untouched = current.join(assessed.select("parcel_id"), "parcel_id", "left_anti")
    return untouched.unionByName(assessed.filter("confidence_band IS NOT NULL").select(*current.columns))


def newest_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
