"""Registered queries of table maintenance, scans, anti and semi joins, and operations reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck
from landspark.functions import planning as p
from landspark.operators import tables as ops
from landspark.queries import query

PARCELS, LEADS, LISTINGS, RETRY, ZONES, SIGNALS = (f"WITH {duck(n)}" for n in ("fx_parcels", "fx_leads", "fx_listings", "fx_retry", "fx_zones", "fx_signals"))
USE = "coalesce(nullif(trim(current_use), ''), '(missing)')"


@query("a1_pending_listings", f"{LISTINGS} SELECT listing_id, created_at FROM fx_listings WHERE listing_id % 3 <> 0 ORDER BY created_at, listing_id LIMIT 50")
def a1_pending_listings(spark, sf_dir):
    """The oldest unprocessed listings (A1)."""
    rows = derived(spark, sf_dir, "fx_listings").withColumn("is_processed", F.col("listing_id") % 3 == 0)
    return ops.pending_listings(rows, 50).select("listing_id", "created_at")


@query("a2_register_listings", "SELECT coalesce(min(doc_id) FILTER (WHERE doc_id % 2 = 0), min(doc_id)) AS doc_id, sha256(coalesce(source, '') || coalesce(text, '')) AS hash FROM documents GROUP BY 2")
def a2_register_listings(spark, sf_dir):
    """Documents registered as listings, once for each hash of address and text; those with even ids are there already (A2)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", ops.listing_hash(F.col("source"), F.col("text")).alias("hash"))
    current = ops.newest(docs.filter("doc_id % 2 = 0"), ["hash"], [F.asc("doc_id")])
    return ops.insert_absent(current, docs.filter("doc_id % 2 = 1"), ["hash"], [F.asc("doc_id")])


@query("c8_unanalysed", f"WITH {duck('fx_parcels', 'fx_leads')} SELECT parcel_id FROM fx_parcels WHERE parcel_id NOT IN (SELECT parcel_id FROM fx_leads WHERE strategy_type = 'future_buildable')")
def c8_unanalysed(spark, sf_dir):
    """Parcels without an assessment."""
    return derived(spark, sf_dir, "fx_parcels").join(derived(spark, sf_dir, "fx_leads").filter("strategy_type = 'future_buildable'"), "parcel_id", "left_anti").select("parcel_id")


@query("c9_stale_retry", f"WITH {duck('fx_retry', 'fx_listings')} SELECT listing_id FROM fx_retry WHERE listing_id IN (SELECT listing_id FROM fx_listings)")
def c9_stale_retry(spark, sf_dir):
    """Queue rows whose listing already has parcels."""
    return derived(spark, sf_dir, "fx_retry").join(derived(spark, sf_dir, "fx_listings"), "listing_id", "left_semi").select("listing_id")


@query("c11_coverage_alias", "SELECT CASE WHEN c IN ('1261029', '1261039', '1261049', '1261059') THEN '1261011' ELSE c END AS code, count(*) AS n FROM (SELECT '12610' || (c_custkey % 9 + 1) || CASE WHEN c_custkey % 2 = 0 THEN '9' ELSE '1' END AS c FROM customer) GROUP BY 1")
def c11_coverage_alias(spark, sf_dir):
    """District codes counted under their city (C11)."""
    code = F.concat(F.lit("12610"), (F.col("c_custkey") % 9 + 1).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "9").otherwise("1"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(p.coverage_alias(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("d1_current_use_summary", f"{PARCELS} SELECT count(*) AS n, count_if(trim(coalesce(current_use, '')) <> '') AS filled, count_if(trim(coalesce(current_use, '')) = '') AS missing FROM fx_parcels WHERE teryt_gmina LIKE '12%'")
def d1_current_use_summary(spark, sf_dir):
    """Parcels of a province with and without a land use."""
    blank = F.trim(F.coalesce("current_use", F.lit(""))) == ""
    return derived(spark, sf_dir, "fx_parcels").filter("teryt_gmina LIKE '12%'").agg(F.count(F.lit(1)).alias("n"), F.count_if(~blank).alias("filled"), F.count_if(blank).alias("missing"))


@query("d2_current_use_by_code", f"{PARCELS} SELECT {USE} AS code, count(*) AS n FROM fx_parcels GROUP BY 1 ORDER BY n DESC, code LIMIT 8")
def d2_current_use_by_code(spark, sf_dir):
    """The most frequent land-use codes."""
    return derived(spark, sf_dir, "fx_parcels").groupBy(F.coalesce(F.nullif(F.trim("current_use"), F.lit("")), F.lit("(missing)")).alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(8)


@query("d3_missing_use_by_gmina", f"{PARCELS} SELECT teryt_gmina, count(*) AS n, min(parcel_id) AS sample_id FROM fx_parcels WHERE trim(coalesce(current_use, '')) = '' GROUP BY teryt_gmina")
def d3_missing_use_by_gmina(spark, sf_dir):
    """Parcels without a land use by commune (D3)."""
    return derived(spark, sf_dir, "fx_parcels").filter(F.trim(F.coalesce("current_use", F.lit(""))) == "").groupBy("teryt_gmina").agg(F.count(F.lit(1)).alias("n"), F.min("parcel_id").alias("sample_id"))


@query("d6_uncovered_gminas", f"WITH {duck('fx_parcels', 'fx_loaded', 'fx_listings')}, u AS (SELECT * FROM fx_parcels WHERE teryt_gmina NOT IN (SELECT teryt_gmina FROM fx_loaded)) SELECT u.teryt_gmina, count(DISTINCT u.parcel_id) AS n, string_agg(DISTINCT current_use, ',' ORDER BY current_use) AS uses, min(source_url) AS url FROM u LEFT JOIN fx_listings USING (parcel_id) GROUP BY u.teryt_gmina")
def d6_uncovered_gminas(spark, sf_dir):
    """Communes with parcels but no zones: parcels, land uses and a listing."""
    zones = derived(spark, sf_dir, "fx_loaded").select("teryt_gmina")
    rows = derived(spark, sf_dir, "fx_parcels").join(zones, "teryt_gmina", "left_anti").join(derived(spark, sf_dir, "fx_listings").groupBy("parcel_id").agg(F.min("source_url").alias("u")), "parcel_id", "left")
    return rows.groupBy("teryt_gmina").agg(F.countDistinct("parcel_id").alias("n"), F.nullif(F.array_join(F.array_sort(F.collect_set("current_use")), ","), F.lit("~")).alias("uses"), F.min("u").alias("url"))


@query(
    "d7_covered_no_leads",
    f"""WITH {duck('fx_parcels', 'fx_loaded', 'fx_open_leads', 'fx_listings', 'fx_signals')}, p AS (SELECT teryt_gmina, count(*) AS parcels FROM fx_parcels GROUP BY 1), z AS (SELECT teryt_gmina, count(*) AS zones FROM fx_loaded GROUP BY 1),
li AS (SELECT teryt_gmina, count(DISTINCT listing_id) AS listings FROM fx_listings JOIN fx_parcels USING (parcel_id) GROUP BY 1), s AS (SELECT teryt_gmina, count(*) AS signals FROM fx_signals GROUP BY 1)
SELECT teryt_gmina, parcels, zones, coalesce(listings, 0) AS listings, coalesce(signals, 0) AS signals, 0 AS leads FROM p JOIN z USING (teryt_gmina) LEFT JOIN li USING (teryt_gmina) LEFT JOIN s USING (teryt_gmina) WHERE teryt_gmina NOT IN (SELECT teryt_gmina FROM fx_open_leads)""",
)
def d7_covered_no_leads(spark, sf_dir):
    """Covered communes without leads, with five counts; each side is counted before the join."""
    table = lambda name: derived(spark, sf_dir, name)
    count = lambda df, c: df.groupBy("teryt_gmina").agg(F.count(F.lit(1)).alias(c))
    listed = table("fx_listings").select("listing_id", "parcel_id").distinct().join(table("fx_parcels").select("parcel_id", "teryt_gmina"), "parcel_id")
    rows = count(table("fx_parcels"), "parcels").join(count(table("fx_loaded"), "zones"), "teryt_gmina").join(table("fx_open_leads"), "teryt_gmina", "left_anti")
    rows = rows.join(count(listed, "listings"), "teryt_gmina", "left").join(count(table("fx_signals"), "signals"), "teryt_gmina", "left")
    return rows.select("teryt_gmina", "parcels", "zones", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("listings", "signals")), F.lit(0).alias("leads"))


ERR = "lower(trim(coalesce(last_error, '')))"
CATEGORY = f"""CASE WHEN attempt_count >= 5 OR {ERR} LIKE '%manual_review_required%' OR {ERR} LIKE '%geometry_missing%' OR {ERR} LIKE '%unsupported%' THEN 'manual_only_case'
  WHEN regexp_matches(coalesce(raw_numer_dzialki, ''), '\\p{{L}}') OR lower(coalesce(raw_obreb, '')) LIKE '%użytkowanie wieczyste%' THEN 'parser_issue'
  WHEN {ERR} LIKE '%parse%' OR {ERR} LIKE '%extract%' OR {ERR} LIKE '%missing parcel%' OR {ERR} LIKE '%no parcel number%' THEN 'parser_issue'
  WHEN {ERR} LIKE '%planning source%' OR {ERR} LIKE '%no_source%' OR {ERR} LIKE '%source_configured%' THEN 'missing_planning_source' ELSE 'resolver_ambiguity' END"""


def categorised(spark, sf_dir):
    return derived(spark, sf_dir, "fx_retry").withColumn("category", p.retry_category(F.col("last_error"), F.col("attempt_count"), F.col("raw_obreb"), F.col("raw_numer_dzialki")))


@query("i17_retry_category", f"{RETRY} SELECT listing_id, {CATEGORY} AS category FROM fx_retry")
def i17_retry_category(spark, sf_dir):
    """Category of every queue row."""
    return categorised(spark, sf_dir).select("listing_id", "category")


@query("d19_retry_histogram", f"{RETRY} SELECT {CATEGORY} AS category, last_error, count(*) AS n FROM fx_retry GROUP BY ALL")
def d19_retry_histogram(spark, sf_dir):
    """Queue rows by category and error."""
    return categorised(spark, sf_dir).groupBy("category", "last_error").agg(F.count(F.lit(1)).alias("n"))


@query("d22_corpus_summary", f"{LEADS} SELECT status, substr(teryt_gmina, 1, 2) AS province, count(*) AS n, count_if(confidence_band IS NULL) AS no_band FROM fx_leads GROUP BY GROUPING SETS ((status), (substr(teryt_gmina, 1, 2)), ())")
def d22_corpus_summary(spark, sf_dir):
    """Labelled rows by label, by province and in all, in one pass of grouping sets."""
    rows = derived(spark, sf_dir, "fx_leads").select("status", F.substring("teryt_gmina", 1, 2).alias("province"), "confidence_band")
    return rows.groupingSets([["status"], ["province"], []], "status", "province").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence_band").isNull()).alias("no_band"))


@query("d23_status_counts", f"WITH {duck('fx_parcels', 'fx_zones', 'fx_listings', 'fx_leads')} SELECT 'parcels' AS layer, count(*) AS n FROM fx_parcels UNION ALL SELECT 'zones', count(*) FROM fx_zones UNION ALL SELECT 'listings', count(*) FROM fx_listings UNION ALL SELECT 'leads', count(*) FROM fx_leads")
def d23_status_counts(spark, sf_dir):
    """Rows of each layer as one long table."""
    parts = [derived(spark, sf_dir, f"fx_{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("layer"), "n") for n in ("parcels", "zones", "listings", "leads")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("d24_province_status", f"WITH {duck('fx_parcels', 'fx_leads')}, p AS (SELECT teryt_gmina, count(*) AS parcels FROM fx_parcels WHERE teryt_gmina LIKE '24%' GROUP BY 1), l AS (SELECT teryt_gmina, count(*) AS leads FROM fx_leads GROUP BY 1) SELECT teryt_gmina, parcels, coalesce(leads, 0) AS leads FROM p LEFT JOIN l USING (teryt_gmina) ORDER BY parcels DESC, teryt_gmina LIMIT 8")
def d24_province_status(spark, sf_dir):
    """The eight communes of a province with most parcels, and their leads."""
    parcels = derived(spark, sf_dir, "fx_parcels").filter("teryt_gmina LIKE '24%'").groupBy("teryt_gmina").agg(F.count(F.lit(1)).alias("parcels"))
    leads = derived(spark, sf_dir, "fx_leads").groupBy("teryt_gmina").agg(F.count(F.lit(1)).alias("leads"))
    return parcels.join(leads, "teryt_gmina", "left").select("teryt_gmina", "parcels", F.coalesce("leads", F.lit(0)).alias("leads")).orderBy(F.desc("parcels"), "teryt_gmina").limit(8)


@query("d29_pipeline_rates", f"WITH {duck('fx_parcels', 'fx_leads')} SELECT round((SELECT count(DISTINCT parcel_id) FROM fx_leads WHERE confidence_score >= 0.9)::DOUBLE / (SELECT count(*) FROM fx_parcels), 3) AS conversion")
def d29_pipeline_rates(spark, sf_dir):
    """Share of parcels that became prime leads."""
    leads = derived(spark, sf_dir, "fx_leads").filter("confidence_score >= 0.9").agg(F.countDistinct("parcel_id").alias("a"))
    return leads.join(derived(spark, sf_dir, "fx_parcels").agg(F.count(F.lit(1)).alias("b")), F.lit(True)).select(F.coalesce(F.bround(F.try_divide("a", "b"), 3), F.lit(0.0)).alias("conversion"))


STATUS = "CASE WHEN NOT z THEN CASE WHEN r THEN 'source_configured_but_not_loaded' ELSE 'no_source_configured' END WHEN d THEN 'covered_but_no_buildable_delta' ELSE 'covered_but_no_delta' END"


@query("i18_backlog_status", f"WITH {duck('fx_parcels', 'fx_loaded')}, g AS (SELECT teryt_gmina, count(*) AS n, teryt_gmina IN (SELECT teryt_gmina FROM fx_loaded) AS z, substr(teryt_gmina, 3, 2) > '10' AS r, count_if(current_use = 'R') > 20 AS d FROM fx_parcels GROUP BY teryt_gmina) SELECT teryt_gmina, n, {STATUS} AS status FROM g ORDER BY list_position(['no_source_configured', 'source_configured_but_not_loaded', 'covered_but_no_delta', 'covered_but_no_buildable_delta'], status), n DESC, teryt_gmina LIMIT 60")
def i18_backlog_status(spark, sf_dir):
    """Communes of the backlog by status, ranked."""
    zones = derived(spark, sf_dir, "fx_loaded").select("teryt_gmina").distinct().withColumn("z", F.lit(True))
    rows = derived(spark, sf_dir, "fx_parcels").groupBy("teryt_gmina").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("current_use") == "R") > 20).alias("d")).join(zones, "teryt_gmina", "left")
    status = p.backlog_status(F.substring("teryt_gmina", 3, 2) > "10", F.coalesce("z", F.lit(False)), F.col("d"))
    order = F.array_position(F.array(*map(F.lit, ("no_source_configured", "source_configured_but_not_loaded", "covered_but_no_delta", "covered_but_no_buildable_delta"))), F.col("status"))
    return rows.select("teryt_gmina", "n", status.alias("status")).orderBy(order, F.desc("n"), "teryt_gmina").limit(60)


@query("i11_buildable_status", f"WITH {duck('fx_parcels', 'fx_leads')}, c AS (SELECT DISTINCT parcel_id FROM fx_leads WHERE strategy_type = 'current_buildable'), u AS (SELECT DISTINCT parcel_id FROM fx_leads) SELECT parcel_id, CASE WHEN parcel_id IN (FROM c) THEN 'already_buildable' WHEN parcel_id IN (FROM u) THEN 'mixed' WHEN trim(coalesce(current_use, '')) IN ('B', 'Ba', 'Bi', 'Bp', 'K') THEN 'already_buildable' WHEN trim(coalesce(current_use, '')) IN ('R', 'Ł', 'Ps', 'Ls', 'Lz', 'S', 'N', 'W', 'dr', '') THEN 'non_buildable' ELSE 'mixed' END AS status FROM fx_parcels")
def i11_buildable_status(spark, sf_dir):
    """Whether each parcel can be built on today."""
    leads = derived(spark, sf_dir, "fx_leads")
    flag = lambda df, c: df.select("parcel_id").distinct().withColumn(c, F.lit(True))
    rows = derived(spark, sf_dir, "fx_parcels").join(flag(leads.filter("strategy_type = 'current_buildable'"), "c"), "parcel_id", "left").join(flag(leads, "u"), "parcel_id", "left")
    use = F.trim(F.coalesce("current_use", F.lit("")))
    status = F.when(F.col("c"), "already_buildable").when(F.col("u"), "mixed").when(use.isin(*p.BUILT), "already_buildable").when(use.isin(*p.AGRICULTURAL, ""), "non_buildable").otherwise("mixed")
    return rows.select("parcel_id", status.alias("status"))


@query("e7_second_auctions", f"{LISTINGS} SELECT parcel_id, min_by(listing_id, (created_at, listing_id)) AS listing_id, max_by(price_zl, (created_at, listing_id)) AS price_zl, max(created_at) AS created_at, count(*) AS n_auctions FROM fx_listings GROUP BY parcel_id")
def e7_second_auctions(spark, sf_dir):
    """Repeated auctions of a parcel as one listing."""
    return ops.collapse_second_auctions(derived(spark, sf_dir, "fx_listings"), ["parcel_id"])


@query("e8_infer_current_use", f"{LISTINGS}, u AS (SELECT parcel_id, created_at, listing_id, CASE WHEN source_url LIKE '%-las%' THEN 'Ls' WHEN source_url LIKE '%-roln%' THEN 'R' WHEN source_url LIKE '%-budowlan%' THEN 'Bp' END AS use FROM fx_listings) SELECT parcel_id, use AS current_use FROM u WHERE use IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY created_at DESC, listing_id DESC) = 1")
def e8_infer_current_use(spark, sf_dir):
    """The land use that the newest hinting listing of each parcel suggests."""
    rows = derived(spark, sf_dir, "fx_listings").withColumn("current_use", ops.infer_use(F.col("source_url"))).filter("current_use IS NOT NULL")
    return rows.groupBy("parcel_id").agg(F.max_by("current_use", F.struct("created_at", "listing_id")).alias("current_use"))


@query("j1_upsert_zones", f"{ZONES} SELECT zone_id, CASE WHEN plan_type <> 'studium' THEN 'new plan' ELSE plan_name END AS plan_name, CASE WHEN plan_type = 'pog' THEN upper(symbol) ELSE symbol END AS symbol FROM fx_zones")
def j1_upsert_zones(spark, sf_dir):
    """Zones upserted by key; the stored symbol stays (J1): studies are stored only, general plans are new only, local plans are both."""
    zones = derived(spark, sf_dir, "fx_zones").select("zone_id", "symbol", "plan_name", "plan_type")
    new = zones.filter("plan_type <> 'studium'").withColumn("plan_name", F.lit("new plan")).withColumn("symbol", F.upper("symbol")).drop("plan_type")
    return ops.upsert(zones.filter("plan_type <> 'pog'").drop("plan_type"), new, ["zone_id"], keep=["symbol"])


@query("j3_save_deltas", f"{LEADS} SELECT parcel_id, lead_id AS zone_id, lead_id % 4 AS v FROM fx_leads WHERE lead_id % 4 = 1 UNION ALL SELECT parcel_id, lead_id, lead_id % 4 FROM fx_leads WHERE lead_id % 4 <> 1 AND parcel_id NOT IN (SELECT parcel_id FROM fx_leads WHERE lead_id % 4 = 1)")
def j3_save_deltas(spark, sf_dir):
    """Forced save: the parcels that are computed anew lose their old rows."""
    rows = derived(spark, sf_dir, "fx_leads").selectExpr("parcel_id", "lead_id AS zone_id", "lead_id % 4 AS v")
    return ops.save_deltas(rows.filter("v <> 1"), rows.filter("v = 1"), force=True)


ONE = "SELECT parcel_id, strategy_type, confidence_score, price_per_m2_zl FROM fx_leads WHERE {0} QUALIFY row_number() OVER (PARTITION BY parcel_id, strategy_type ORDER BY lead_id) = 1"


@query("j4_upsert_leads", f"{LEADS}, c AS ({ONE.format('lead_id % 4 < 2')}), n AS ({ONE.format('lead_id % 4 > 0')}) SELECT parcel_id, strategy_type, greatest(c.confidence_score, n.confidence_score) AS confidence_score, coalesce(n.price_per_m2_zl, c.price_per_m2_zl) AS price_per_m2_zl, CASE WHEN c.confidence_score IS NULL THEN 1 ELSE 1 + coalesce((n.confidence_score > c.confidence_score)::INT, 0) END AS n_evidence FROM c FULL JOIN n USING (parcel_id, strategy_type)")
def j4_upsert_leads(spark, sf_dir):
    """Leads upserted: only a higher score replaces, the price is refreshed, evidence grows."""
    leads = derived(spark, sf_dir, "fx_leads")
    pick = lambda test: ops.newest(leads.filter(test), ["parcel_id", "strategy_type"], [F.asc("lead_id")]).select("parcel_id", "strategy_type", "confidence_score", p.priority(F.col("confidence_score")).alias("priority"), "price_per_m2_zl", F.array(F.struct(F.lit("delta").alias("step"), F.col("lead_id").cast("string").alias("ref"))).alias("evidence"))
    out = ops.upsert_leads(pick("lead_id % 4 < 2"), pick("lead_id % 4 > 0"))
    return out.select("parcel_id", "strategy_type", "confidence_score", "price_per_m2_zl", F.size("evidence").alias("n_evidence"))


@query("j8_update_retry", f"{RETRY}, t AS (SELECT listing_id, least(attempt_count + (listing_id % 3 = 0)::INT, 5) AS attempt_count, last_error, listing_id % 3 = 0 AS f, next_retry_at AS o FROM fx_retry) SELECT listing_id, attempt_count::INT AS attempt_count, CASE WHEN NOT f THEN o::TIMESTAMP WHEN attempt_count >= 5 OR upper(last_error) LIKE '%GEOMETRY_MISSING%' THEN TIMESTAMP '9999-12-31' ELSE TIMESTAMP '2026-01-01' + to_hours([1, 4, 24, 72][least(attempt_count, 4)]) END AS next_retry_at FROM t")
def j8_update_retry(spark, sf_dir):
    """The retry queue after failures of every third listing."""
    rows = derived(spark, sf_dir, "fx_retry").withColumn("next_retry_at", F.col("next_retry_at").cast("timestamp"))
    out = ops.update_retry_queue(rows, rows.filter("listing_id % 3 = 0").select("listing_id", "last_error"), F.to_timestamp(F.lit("2026-01-01")))
    return out.select("listing_id", "attempt_count", "next_retry_at")


@query("j11_backfill_current_use", f"{PARCELS} SELECT parcel_id, CASE WHEN trim(coalesce(current_use, '')) = '' AND parcel_id % 2 = 0 THEN 'R' ELSE current_use END AS current_use FROM fx_parcels")
def j11_backfill_current_use(spark, sf_dir):
    """Land use filled in where it was blank."""
    parcels = derived(spark, sf_dir, "fx_parcels").select("parcel_id", "current_use")
    return ops.backfill_current_use(parcels, parcels.filter("parcel_id % 2 = 0").withColumn("current_use", F.lit("R")))


@query("j14_update_status", f"{LEADS} SELECT lead_id, CASE WHEN lead_id % 5 = 0 THEN 'shortlisted' ELSE status END AS status, lead_id % 5 = 0 AS reviewed FROM fx_leads")
def j14_update_status(spark, sf_dir):
    """Workflow states after changes, those that are not allowed left out."""
    leads = derived(spark, sf_dir, "fx_leads")
    changes = leads.filter("lead_id % 5 < 2").select("lead_id", F.when(F.col("lead_id") % 5 == 0, "shortlisted").otherwise("nonsense").alias("status"))
    return ops.update_status(leads, changes, F.to_timestamp(F.lit("2026-01-01"))).select("lead_id", "status", F.col("reviewed_at").isNotNull().alias("reviewed"))


@query("j16_mark_processed", f"WITH {duck('fx_listings', 'fx_retry')} SELECT listing_id, listing_id IN (SELECT listing_id FROM fx_retry) AS is_processed FROM fx_listings")
def j16_mark_processed(spark, sf_dir):
    """Listings marked as processed."""
    rows = derived(spark, sf_dir, "fx_listings").withColumn("is_processed", F.lit(False))
    return ops.mark_processed(rows, derived(spark, sf_dir, "fx_retry")).select("listing_id", "is_processed")


@query("g2_price_consistency", f"{LEADS}, c AS (SELECT price_per_m2_zl AS s, price_zl / area_m2 AS r, lead_id % 10 = 0 AS off FROM fx_leads) SELECT count(*) AS n, count_if(s IS NULL) AS missing, coalesce(count_if(abs(s + off::INT * 5 - r) > 0.05), 0) AS mismatch FROM c")
def g2_price_consistency(spark, sf_dir):
    """Stored prices per m² against recomputed ones."""
    gap = F.abs(F.col("price_per_m2_zl") + F.when(F.col("lead_id") % 10 == 0, 5).otherwise(0) - F.col("price_zl") / F.col("area_m2"))
    return derived(spark, sf_dir, "fx_leads").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price_per_m2_zl").isNull()).alias("missing"), F.count_if(gap > 0.05).alias("mismatch"))


@query("g3_merge_parcels", f"WITH {duck('fx_listings')}, a AS (SELECT parcel_id, 1 AS pr, min(listing_id) AS v FROM fx_listings WHERE listing_id % 2 = 0 GROUP BY 1), b AS (SELECT parcel_id, 2 AS pr, min(listing_id) AS v FROM fx_listings GROUP BY 1) SELECT parcel_id, pr AS source, v FROM (FROM a UNION ALL FROM b) QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY pr) = 1")
def g3_merge_parcels(spark, sf_dir):
    """Two sets of parcels merged by id; the first wins."""
    rows = derived(spark, sf_dir, "fx_listings")
    part = lambda df, n: df.groupBy("parcel_id").agg(F.min("listing_id").alias("v")).withColumn("source", F.lit(n))
    return ops.newest(part(rows.filter("listing_id % 2 = 0"), 1).unionByName(part(rows, 2)), ["parcel_id"], [F.asc("source")])


@query("hdq1_validate_leads", f"{LEADS} SELECT 'coverage_range' AS rule, count(*) AS n_rows, count(*) - coalesce(count_if(max_coverage_pct BETWEEN 0 AND 100), 0) AS n_violations FROM fx_leads UNION ALL SELECT 'status_domain', count(*), count(*) - count_if(status IN ('new', 'reviewed', 'shortlisted')) FROM fx_leads UNION ALL SELECT 'price_positive', count(*), count(*) - count_if(coalesce(price_zl, 1) > 0) FROM fx_leads")
def hdq1_validate_leads(spark, sf_dir):
    """Violations of range, domain and sign rules in one pass (H-DQ1)."""
    return ops.validate(derived(spark, sf_dir, "fx_leads"), {"coverage_range": F.col("max_coverage_pct").between(0, 100), "status_domain": F.col("status").isin("new", "reviewed", "shortlisted"), "price_positive": F.coalesce("price_zl", F.lit(1)) > 0})


@query("hdq2_area_discrepancy", f"{LEADS} SELECT CASE WHEN g > 0.15 THEN 'reject' WHEN g > 0.05 THEN 'flag' ELSE 'ok' END AS verdict, count(*) AS n FROM (SELECT abs(area_m2 - (area_m2 + lead_id % 300 - 100))::DOUBLE / area_m2::DOUBLE AS g FROM fx_leads) GROUP BY 1")
def hdq2_area_discrepancy(spark, sf_dir):
    """Computed against reported areas (H-DQ2)."""
    gap = F.abs(F.col("area_m2") - (F.col("area_m2") + F.col("lead_id") % 300 - 100)).cast("double") / F.col("area_m2").cast("double")
    return derived(spark, sf_dir, "fx_leads").groupBy(F.when(gap > 0.15, "reject").when(gap > 0.05, "flag").otherwise("ok").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("i28_derive_codes", f"{PARCELS} SELECT parcel_id, substr(teryt_gmina, 1, 2) AS woj, substr(teryt_gmina, 1, 4) AS powiat, substr(teryt_gmina, 1, 6) || '_' || substr(teryt_gmina, 7, 1) || '.' || lpad((parcel_id % 30 + 1)::VARCHAR, 4, '0') || '.' || (parcel_id % 999 + 1) || '/' || (parcel_id % 9 + 1) AS canonical_id FROM fx_parcels")
def i28_derive_codes(spark, sf_dir):
    """Administrative codes and canonical id of every parcel."""
    numer = F.concat((F.col("parcel_id") % 999 + 1).cast("string"), F.lit("/"), (F.col("parcel_id") % 9 + 1).cast("string"))
    return ops.derive_codes(derived(spark, sf_dir, "fx_parcels").withColumn("numer", numer)).select("parcel_id", "woj", "powiat", "canonical_id")
