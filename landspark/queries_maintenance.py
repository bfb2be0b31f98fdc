"""Registered queries of quarantine, follow-ups, saving and small report rules; all return their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck
from landspark.operators import maintenance as ops
from landspark.queries import query

#: Future leads and local plans only, so that some parcels are left without either.
HELD = f"""WITH {duck('fx_parcels', 'fx_zones', 'fx_listings', 'fx_leads')},
ld AS (SELECT DISTINCT parcel_id FROM fx_leads WHERE strategy_type = 'future_buildable'), z AS (SELECT DISTINCT teryt_gmina FROM fx_zones WHERE plan_type = 'mpzp'),
nw AS (SELECT parcel_id, source_url FROM fx_listings QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY created_at DESC, listing_id DESC) = 1),
q AS (SELECT parcel_id, p.teryt_gmina, source_url, z.teryt_gmina IS NOT NULL AS has_planning_zones FROM fx_parcels p LEFT JOIN z USING (teryt_gmina) LEFT JOIN nw USING (parcel_id) WHERE parcel_id NOT IN (SELECT parcel_id FROM ld))"""
SAYS = "CASE WHEN has_planning_zones THEN '{0}' ELSE '{1}' END"
SCORE = " + ".join(f"CASE WHEN contains(lower(coalesce(source_url, '')), '{w}') THEN {v} ELSE 0.0 END" for w, v in ops.HINTS.items())


def held(spark, sf_dir, **options):
    parcels, zones, listings, leads = (derived(spark, sf_dir, n) for n in ("fx_parcels", "fx_zones", "fx_listings", "fx_leads"))
    return ops.quarantine(parcels.select("parcel_id", "teryt_gmina"), leads.filter("strategy_type = 'future_buildable'"), zones.filter("plan_type = 'mpzp'"), listings, **options)


@query("k12_quarantine_list", f"{HELD} SELECT parcel_id, teryt_gmina, source_url, {SAYS.format(ops.NO_LEAD[0], ops.NO_PLAN[0])} AS status, {SAYS.format(ops.NO_LEAD[1], ops.NO_PLAN[1])} AS reason FROM q")
def k12_quarantine_list(spark, sf_dir):
    """Parcels without a future lead, with reason, status and newest address."""
    return held(spark, sf_dir).select("parcel_id", "teryt_gmina", "source_url", "status", "reason")


@query("k12_quarantine_count", f"{HELD} SELECT count(*) AS n FROM q WHERE NOT has_planning_zones")
def k12_quarantine_count(spark, sf_dir):
    """How many of them lie in communes without a plan."""
    return held(spark, sf_dir, uncovered_only=True).agg(F.count(F.lit(1)).alias("n"))


@query("f9_quarantine_candidates", f"{HELD} SELECT parcel_id, source_url, ({SCORE})::DOUBLE AS score FROM q WHERE contains(lower(source_url), 'budowlane') OR contains(lower(source_url), 'mpzp') ORDER BY score DESC, parcel_id LIMIT 50")
def f9_quarantine_candidates(spark, sf_dir):
    """The most promising quarantined parcels by their address."""
    return ops.quarantine_candidates(held(spark, sf_dir), 50, ["budowlane", "MPZP"]).select("parcel_id", "source_url", "score")


@query("i29_sync_followups", f"WITH {duck('fx_parcels', 'fx_zones')}, z AS (SELECT teryt_gmina, count(*) AS n FROM fx_zones WHERE plan_type = 'pog' GROUP BY 1) SELECT DISTINCT p.teryt_gmina AS teryt, 'sync_zero_features:' || p.teryt_gmina || ':gmina ' || p.teryt_gmina || ' -> needs_manual_probe' AS message FROM fx_parcels p LEFT JOIN z USING (teryt_gmina) WHERE z.n IS NULL")
def i29_sync_followups(spark, sf_dir):
    """Messages for communes whose sync brought no general plan."""
    brought = derived(spark, sf_dir, "fx_zones").filter("plan_type = 'pog'").groupBy("teryt_gmina").agg(F.count(F.lit(1)).alias("upserted"))
    report = derived(spark, sf_dir, "fx_parcels").select("teryt_gmina").distinct().join(brought, "teryt_gmina", "left")
    return ops.sync_followups(report.select(F.col("teryt_gmina").alias("teryt"), F.concat(F.lit("gmina "), "teryt_gmina").alias("label"), F.lit("ok").alias("status"), "upserted"))


@query("h25_snippets", f"WITH {duck('fx_notices')}, m AS (SELECT listing_id, text, regexp_extract(text, 'KW [A-Z0-9]+/[0-9]+/[0-9]') AS hit FROM fx_notices), o AS (SELECT *, strpos(text, hit) - 1 AS pos FROM m) SELECT listing_id, trim(substr(text, greatest(pos - 25, 0) + 1, pos + len(hit) + 25 - greatest(pos - 25, 0))) AS snippet FROM o")
def h25_snippets(spark, sf_dir):
    """What stands around each notice's register number."""
    pattern = F.lit(r"KW [A-Z0-9]+/\d+/\d")
    hit = F.regexp_substr("text", pattern)
    return derived(spark, sf_dir, "fx_notices").select("listing_id", ops.snippet(F.col("text"), F.regexp_instr("text", pattern) - 1, F.length(hit), 25).alias("snippet"))


@query("h28_register_links", f"WITH {duck('fx_notices')}, n AS (SELECT listing_id, [' WA1M/', 'gd4k/', 'PO1P/', 'KR1K'][listing_id % 4 + 1] || lpad(listing_id::VARCHAR, 8, '0') || '/' || (listing_id % 10) || CASE WHEN listing_id % 7 = 0 THEN '1' ELSE '' END AS number FROM fx_notices) SELECT listing_id, CASE WHEN listing_id % 4 IN (0, 2) AND listing_id % 7 <> 0 AND listing_id < 100000000 THEN '{ops.REGISTER_SEARCH}' END AS link FROM n")
def h28_register_links(spark, sf_dir):
    """The register's search page for canonical numbers, none for others."""
    ids = derived(spark, sf_dir, "fx_notices").select("listing_id")
    court = F.get(F.array(*map(F.lit, (" WA1M/", "gd4k/", "PO1P/", "KR1K"))), (F.col("listing_id") % 4).cast("int"))
    number = F.concat(court, F.lpad(F.col("listing_id").cast("string"), 8, "0"), F.lit("/"), (F.col("listing_id") % 10).cast("string"), F.when(F.col("listing_id") % 7 == 0, "1").otherwise(""))
    return ids.select("listing_id", ops.register_link(number).alias("link"))


BOX = (500_500.0, 300_000.0, 519_500.0, 319_000.0)
PIXEL = "greatest(0, least({1}, round_even({0} * {1}, 0)::INT))"


@query("b20_pixels", f"WITH {duck('fx_parcels')} SELECT parcel_id, {PIXEL.format(f'(x0 - {BOX[0]}::DOUBLE) / 19000.0::DOUBLE', 1023)} AS px, {PIXEL.format(f'({BOX[3]}::DOUBLE - y0) / 19000.0::DOUBLE', 767)} AS py FROM fx_parcels")
def b20_pixels(spark, sf_dir):
    """Each parcel's corner as a pixel of a picture that ends within the area, so that some are clamped."""
    px, py = ops.pixel_of(F.col("x0").cast("double"), F.col("y0").cast("double"), BOX, 1024, 768)
    return derived(spark, sf_dir, "fx_parcels").select("parcel_id", px.alias("px"), py.alias("py"))


@query("j2_upsert_parcels", f"WITH {duck('fx_cadastre')}, o AS (SELECT cad_id, max(area_m2) AS area_m2 FROM fx_cadastre WHERE woj <> '12' GROUP BY 1), n AS (SELECT cad_id, min(area_m2) AS area_m2 FROM fx_cadastre WHERE woj <> '18' GROUP BY 1) SELECT cad_id, coalesce(n.area_m2, o.area_m2) AS area_m2 FROM o FULL JOIN n USING (cad_id)")
def j2_upsert_parcels(spark, sf_dir):
    """Resolved parcels put in by their canonical id, or in place of what was there."""
    rows = derived(spark, sf_dir, "fx_cadastre")
    old = rows.filter("woj <> '12'").groupBy("cad_id").agg(F.max("area_m2").alias("area_m2"))
    new = rows.filter("woj <> '18'").groupBy("cad_id").agg(F.min("area_m2").alias("area_m2"))
    return ops.upsert(old, new, ["cad_id"])


@query("j2_link_listings", f"WITH {duck('fx_listings')} SELECT listing_id, parcel_id, min(CASE WHEN price_zl < 30000 THEN 'old' ELSE 'new' END) AS origin FROM fx_listings GROUP BY 1, 2")
def j2_link_listings(spark, sf_dir):
    """Links of listings to parcels, put in where there is none."""
    rows = derived(spark, sf_dir, "fx_listings")
    links = lambda df, origin: df.select("listing_id", "parcel_id", F.lit(origin).alias("origin"))
    return ops.insert_absent(links(rows.filter("price_zl < 30000"), "old"), links(rows, "new"), ["listing_id", "parcel_id"])


@query("j2_clear_retry", f"WITH {duck('fx_retry', 'fx_listings')} SELECT listing_id, attempt_count, last_error FROM fx_retry WHERE listing_id NOT IN (SELECT listing_id FROM fx_listings)")
def j2_clear_retry(spark, sf_dir):
    """The retry queue without what has been resolved."""
    return ops.clear_resolved(derived(spark, sf_dir, "fx_retry"), derived(spark, sf_dir, "fx_listings")).select("listing_id", "attempt_count", "last_error")


FUTURE = "SELECT parcel_id, confidence_band, overall_score FROM fx_leads WHERE {0} QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY lead_id) = 1"
OLD, NEW = "strategy_type = 'future_buildable' AND confidence_band IS NOT NULL", "lead_id % 2 = 1"


@query("j5_refresh_future_leads", f"WITH {duck('fx_leads')}, o AS ({FUTURE.format(OLD)}), n AS ({FUTURE.format(NEW)}) SELECT * FROM o WHERE parcel_id NOT IN (SELECT parcel_id FROM n) UNION ALL SELECT * FROM n WHERE confidence_band IS NOT NULL")
def j5_refresh_future_leads(spark, sf_dir):
    """Future leads after an assessment: new rows for parcels with a band, none for those without."""
    leads = derived(spark, sf_dir, "fx_leads")
    one = lambda test: ops.newest_of(leads.filter(test), ["parcel_id"], [F.asc("lead_id")]).select("parcel_id", "confidence_band", "overall_score")
    return ops.refresh_future_leads(one(OLD), one(NEW))


@query("j5_upsert_assessments", f"WITH {duck('fx_leads')}, o AS ({FUTURE.format(OLD)}), n AS ({FUTURE.format(NEW)}) SELECT * FROM o WHERE parcel_id NOT IN (SELECT parcel_id FROM n) UNION ALL SELECT * FROM n")
def j5_upsert_assessments(spark, sf_dir):
    """Assessments by parcel, the new ones in place of the old."""
    leads = derived(spark, sf_dir, "fx_leads")
    one = lambda test: ops.newest_of(leads.filter(test), ["parcel_id"], [F.asc("lead_id")]).select("parcel_id", "confidence_band", "overall_score")
    return ops.upsert(one(OLD), one(NEW), ["parcel_id"])
