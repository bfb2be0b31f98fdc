"""Registered queries over lead views."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck
from landspark.operators import leads as ops
from landspark.queries import query

BASE = f"WITH {duck('fx_leads')}"
SIGNAL = "CASE WHEN price_zl IS NULL AND price_per_m2_zl IS NULL THEN 'missing' WHEN price_zl < 1000 OR price_per_m2_zl < 5 OR price_per_m2_zl > 20000 THEN 'suspicious' ELSE 'reliable' END"
MISSING = "list_filter([" + ", ".join(f"CASE WHEN {m} IS NULL" + (" OR dominant_przeznaczenie = ''" if m == "dominant_przeznaczenie" else "") + f" THEN '{m}' END" for m in ("price_zl", "price_per_m2_zl", "area_m2", "max_buildable_area_m2", "max_coverage_pct", "dominant_przeznaczenie")) + "], lambda x: x IS NOT NULL)"
RULED = f"""{BASE}, s AS (SELECT *, {SIGNAL} AS price_signal, {MISSING} AS missing FROM fx_leads),
q AS (SELECT *, CASE WHEN price_zl IS NULL OR price_per_m2_zl IS NULL THEN 'missing_financials' WHEN price_signal = 'suspicious' OR max_coverage_pct < 15 THEN 'review_required' WHEN len(missing) > 0 THEN 'partial' ELSE 'complete' END AS quality FROM s),
v AS (SELECT *, CASE WHEN strategy_type = 'future_buildable' AND overall_score IS NOT NULL THEN overall_score::DOUBLE ELSE round_even(greatest(
  least(confidence_score, 1) * 35 + least(coalesce(max_coverage_pct, 0), 100)::DOUBLE * 0.35 + least(coalesce(max_buildable_area_m2, 0), 5000)::DOUBLE / 250
  + CASE WHEN price_per_m2_zl > 0 THEN greatest(0, 30 - least(price_per_m2_zl::DOUBLE / 25, 30)) ELSE 0 END
  - CASE price_signal WHEN 'suspicious' THEN 35 WHEN 'missing' THEN 20 ELSE 0 END - CASE quality WHEN 'review_required' THEN 20 WHEN 'missing_financials' THEN 25 WHEN 'partial' THEN 10 ELSE 0 END
  - CASE WHEN max_coverage_pct > 0 AND max_coverage_pct < 30 THEN 12 ELSE 0 END - CASE WHEN max_coverage_pct > 0 AND max_coverage_pct < 15 THEN 18 ELSE 0 END, 0)::DECIMAL(20,8), 2)::DOUBLE END AS investment_score FROM q)"""


def view(spark, sf_dir):
    return ops.with_rules(derived(spark, sf_dir, "fx_leads"))


@query("i8_price_signal", f"{RULED} SELECT lead_id, price_signal FROM v")
def i8_price_signal(spark, sf_dir):
    """Quality of each lead's price (I8)."""
    return view(spark, sf_dir).select("lead_id", "price_signal")


@query("i9_lead_quality", f"{RULED} SELECT lead_id, array_to_string(missing, ',') AS missing, quality FROM v")
def i9_lead_quality(spark, sf_dir):
    """Missing metrics and quality of each lead."""
    return view(spark, sf_dir).select("lead_id", F.array_join("missing", ",").alias("missing"), "quality")


@query("i10_investment_score", f"{RULED} SELECT lead_id, round(investment_score, 1) AS score_1 FROM v WHERE strategy_type = 'future_buildable'")
def i10_investment_score(spark, sf_dir):
    """Investment score of future leads, where the overall score goes before."""
    return view(spark, sf_dir).filter("strategy_type = 'future_buildable'").select("lead_id", F.round(F.col("investment_score").cast("double"), 1).alias("score_1"))


@query("i10_current_score", f"{RULED} SELECT quality, price_signal, count(*) AS n, round(avg(investment_score), 1) AS mean_score FROM v WHERE strategy_type <> 'future_buildable' GROUP BY ALL")
def i10_current_score(spark, sf_dir):
    """Mean investment score of current leads by quality and price signal."""
    rows = view(spark, sf_dir).filter("strategy_type <> 'future_buildable'")
    return rows.groupBy("quality", "price_signal").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("investment_score").cast("double")), 1).alias("mean_score"))


@query("d20_lead_quality_summary", f"{RULED} SELECT quality, count(*) AS n FROM v GROUP BY quality")
def d20_lead_quality_summary(spark, sf_dir):
    """Leads by quality."""
    return view(spark, sf_dir).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


FOUND = "status <> 'rejected' AND confidence_score >= 0.6 AND strategy_type = 'current_buildable' AND price_zl <= 300000 AND area_m2 >= 400 AND max_coverage_pct >= 20 AND teryt_gmina LIKE '12%' AND area_m2 * coalesce(max_coverage_pct, 0) / 100 >= 100"
FILTERS = {"min_score": 0.6, "strategy": "current_buildable", "max_price_zl": 300_000, "min_area_m2": 400, "min_coverage_pct": 20, "teryt_prefix": "12", "min_buildable_area_m2": 100}


@query("f1_search_leads", f"{BASE} SELECT lead_id, confidence_score, created_at FROM fx_leads WHERE {FOUND} ORDER BY confidence_score DESC, created_at DESC, lead_id LIMIT 500")
def f1_search_leads(spark, sf_dir):
    """Filtered and ranked lead search (F1)."""
    return ops.search_leads(derived(spark, sf_dir, "fx_leads"), limit=500, **FILTERS).select("lead_id", "confidence_score", "created_at")


@query("d30_count_leads", f"{BASE} SELECT count(*) AS n FROM fx_leads WHERE {FOUND}")
def d30_count_leads(spark, sf_dir):
    """How many leads the same filters match."""
    return ops.count_leads(derived(spark, sf_dir, "fx_leads"), **FILTERS)


@query("f1_cheap_designation", f"{BASE} SELECT lead_id FROM fx_leads WHERE status <> 'rejected' AND (coalesce(cheapness_score, 0) > 0 OR (strategy_type = 'current_buildable' AND price_per_m2_zl IS NOT NULL)) AND (coalesce(dominant_przeznaczenie, '') ILIKE '%mn%' OR coalesce(dominant_future_signal, '') ILIKE '%mn%')")
def f1_cheap_designation(spark, sf_dir):
    """All cheap leads with a designation (F1 without its limit)."""
    return ops.matching(derived(spark, sf_dir, "fx_leads"), cheap_only=True, designation="mn").select("lead_id")


@query("f2_get_lead", f"{RULED} SELECT lead_id, quality, price_signal, status FROM v WHERE lead_id = 42")
def f2_get_lead(spark, sf_dir):
    """One lead by id (F2)."""
    return view(spark, sf_dir).filter("lead_id = 42").select("lead_id", "quality", "price_signal", "status")


ORDERS = {
    "price_per_m2_asc": "price_signal = 'reliable' DESC, price_per_m2_zl ASC NULLS LAST",
    "total_price_asc": "price_signal = 'reliable' DESC, price_zl ASC NULLS LAST",
    "total_price_desc": "price_signal = 'reliable' DESC, price_zl DESC NULLS LAST",
    "area_desc": "area_m2 DESC NULLS LAST, price_per_m2_zl ASC NULLS LAST",
    "buildable_area_desc": "max_buildable_area_m2 DESC NULLS LAST, max_coverage_pct DESC NULLS LAST",
}


def _sorted(key, order):
    @query(f"f3_sort_{key}", f"{RULED} SELECT lead_id, price_zl, price_per_m2_zl, area_m2, max_buildable_area_m2 FROM v ORDER BY {order}, confidence_score DESC, max_coverage_pct DESC NULLS LAST, lead_id LIMIT 200")
    def run(spark, sf_dir):
        return ops.sort_leads(view(spark, sf_dir), key, 200).select("lead_id", "price_zl", "price_per_m2_zl", "area_m2", "max_buildable_area_m2")

    run.__doc__ = f"The first 200 leads in the order {key} (F3)."


for _key, _order in ORDERS.items():
    _sorted(_key, _order)


@query("f4_filter_view", f"{RULED} SELECT lead_id FROM v WHERE NOT (strategy_type = 'future_buildable' AND confidence_band IS NOT DISTINCT FROM 'speculative') AND price_signal = 'reliable'")
def f4_filter_view(spark, sf_dir):
    """The default future view with reliable prices only."""
    return ops.filter_view(view(spark, sf_dir), "future_buildable").filter("price_signal = 'reliable'").select("lead_id")


@query("f5_top_opportunities", f"{RULED} SELECT lead_id, quality FROM v WHERE quality = 'complete' AND strategy_type = 'current_buildable' ORDER BY confidence_score DESC, max_coverage_pct DESC, max_buildable_area_m2 DESC, price_per_m2_zl, created_at DESC, lead_id LIMIT 5")
def f5_top_opportunities(spark, sf_dir):
    """The five best complete leads by six keys."""
    order = [F.desc("confidence_score"), F.desc("max_coverage_pct"), F.desc("max_buildable_area_m2"), F.asc("price_per_m2_zl"), F.desc("created_at"), F.asc("lead_id")]
    return ops.top_by(view(spark, sf_dir).filter("quality = 'complete' AND strategy_type = 'current_buildable'"), order, 5).select("lead_id", "quality")


@query(
    "d18_investor_snapshot",
    f"""{RULED} SELECT count(*) AS visible, count_if(strategy_type = 'current_buildable') AS current_buildable, count_if(strategy_type = 'future_buildable') AS future_buildable,
  count_if(strategy_type = 'future_buildable' AND confidence_band = 'formal') AS future_formal, count_if(strategy_type = 'future_buildable' AND confidence_band = 'supported') AS future_supported,
  count_if(strategy_type = 'future_buildable' AND confidence_band = 'speculative') AS future_speculative, count(price_per_m2_zl) AS with_price, count_if(price_signal = 'reliable') AS reliable_price,
  count_if(confidence_score >= 0.9) AS prime, min(CASE WHEN price_signal = 'reliable' THEN price_per_m2_zl END) AS best_price_per_m2,
  quantile_cont(CASE WHEN price_signal = 'reliable' THEN price_per_m2_zl::DOUBLE END, 0.5) AS median_price_per_m2, quantile_cont(CASE WHEN strategy_type = 'future_buildable' THEN cheapness_score::DOUBLE END, 0.5) AS median_cheapness,
  min(CASE WHEN price_signal = 'reliable' THEN price_zl END) AS cheapest_entry, round(avg(max_coverage_pct), 4) AS average_coverage_pct FROM v""",
)
def d18_investor_snapshot(spark, sf_dir):
    """Fourteen measures of all leads."""
    return ops.investor_snapshot(view(spark, sf_dir))


@query("d31_lead_sections", f"{BASE} SELECT strategy_type, count(*) AS n, coalesce(count_if(confidence_band = 'formal'), 0) AS n_formal, coalesce(count_if(confidence_band = 'supported'), 0) AS n_supported, coalesce(count_if(confidence_band = 'speculative'), 0) AS n_speculative FROM fx_leads GROUP BY strategy_type")
def d31_lead_sections(spark, sf_dir):
    """Leads by strategy and band."""
    return ops.lead_sections(derived(spark, sf_dir, "fx_leads"))


@query("i24_watchlist_standard", f"{RULED} SELECT lead_id FROM v WHERE confidence_score * 100 >= 70 AND coalesce(max_coverage_pct, 0) >= 40 AND price_signal = 'reliable' AND price_per_m2_zl <= 200 AND upper(trim(coalesce(dominant_przeznaczenie, ''))) LIKE '%MN%'")
def i24_watchlist_standard(spark, sf_dir):
    """Leads that meet a watchlist's criteria."""
    return ops.watchlist_match(view(spark, sf_dir), "standard", 70, 40, True, 200, "mn").select("lead_id")


@query("i24_watchlist_future", f"{RULED} SELECT lead_id FROM v WHERE strategy_type = 'future_buildable' AND coalesce(overall_score, confidence_score * 100) >= 50 AND created_at > TIMESTAMP '1996-06-01' AND upper(trim(coalesce(dominant_future_signal, dominant_przeznaczenie, ''))) LIKE '%ZONE%'")
def i24_watchlist_future(spark, sf_dir):
    """Future leads that meet a watchlist's criteria and are new since its acknowledgement."""
    found = ops.watchlist_match(view(spark, sf_dir), "future_buildable", 50, 30, designation="zone")
    return ops.new_matches(found, F.to_timestamp(F.lit("1996-06-01"))).select("lead_id")


@query("i16_source_status", f"{BASE} SELECT CASE WHEN lead_id % 4 = 0 THEN 'unknown' WHEN created_at::DATE < DATE '1995-01-01' THEN 'expired' ELSE 'live' END AS source_status, count(*) AS n FROM fx_leads GROUP BY 1")
def i16_source_status(spark, sf_dir):
    """Leads by the state of their source at a date (I16)."""
    auction = F.when(F.col("lead_id") % 4 != 0, F.to_date("created_at"))
    return derived(spark, sf_dir, "fx_leads").groupBy(ops.source_status(auction, F.to_date(F.lit("1995-01-01"))).alias("source_status")).agg(F.count(F.lit(1)).alias("n"))


@query("e1_dedupe_leads", f"{BASE} SELECT parcel_id, strategy_type, lead_id FROM fx_leads QUALIFY row_number() OVER (PARTITION BY parcel_id, strategy_type ORDER BY created_at DESC, lead_id DESC) = 1")
def e1_dedupe_leads(spark, sf_dir):
    """The newest lead of each parcel and strategy."""
    return ops.dedupe_leads(derived(spark, sf_dir, "fx_leads")).select("parcel_id", "strategy_type", "lead_id")


@query("e2_latest_listing", f"WITH {duck('fx_listings')} SELECT parcel_id, listing_id, price_zl FROM fx_listings QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY created_at DESC, listing_id DESC) = 1")
def e2_latest_listing(spark, sf_dir):
    """The latest listing of each parcel."""
    return ops.latest_by(derived(spark, sf_dir, "fx_listings"), "parcel_id", ["created_at"], ["listing_id", "price_zl"])


@query("e5_balanced_pick", f"{BASE} SELECT lead_id, substr(teryt_gmina, 1, 2) AS province FROM fx_leads QUALIFY row_number() OVER (PARTITION BY province ORDER BY confidence_score DESC, lead_id) <= 100 ORDER BY row_number() OVER (PARTITION BY province ORDER BY confidence_score DESC, lead_id), list_position(['12', '18', '24'], province) LIMIT 100")
def e5_balanced_pick(spark, sf_dir):
    """A hundred leads in turns from three provinces (E5)."""
    rows = derived(spark, sf_dir, "fx_leads").withColumn("province", F.substring("teryt_gmina", 1, 2))
    return ops.balanced_pick(rows, "province", ["12", "18", "24"], [F.desc("confidence_score"), F.asc("lead_id")], 100).select("lead_id", "province")


@query(
    "c6_lead_view",
    f"WITH {duck('fx_leads', 'fx_parcels', 'fx_listings')}, l AS (SELECT parcel_id, listing_id, source_url FROM fx_listings QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY created_at DESC, listing_id DESC) = 1) SELECT lead_id, p.current_use, p.teryt_gmina, l.listing_id, l.source_url FROM fx_leads JOIN fx_parcels p USING (parcel_id) LEFT JOIN l USING (parcel_id)",
)
def c6_lead_view(spark, sf_dir):
    """Leads with their parcel and, if there is one, their latest listing."""
    latest = ops.latest_by(derived(spark, sf_dir, "fx_listings"), "parcel_id", ["created_at"], ["listing_id", "source_url"])
    parcels = derived(spark, sf_dir, "fx_parcels").select("parcel_id", "current_use", "teryt_gmina")
    return derived(spark, sf_dir, "fx_leads").select("lead_id", "parcel_id").join(parcels, "parcel_id").join(latest, "parcel_id", "left").drop("parcel_id")
