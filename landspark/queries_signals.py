"""Registered queries over planning signals, benchmarks and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landspark.fixtures import derived, duck
from landspark.functions import planning as p
from landspark.operators import signals as ops
from landspark.queries import query

quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
D = "lower(trim(coalesce(designation_normalized, 'unknown')))"
WEIGHT = f"""CASE WHEN {D} IN ({quoted(p.HARD_NEGATIVE)}) THEN -40 WHEN {D} = 'agricultural' AND signal_status <> 'heuristic' THEN -20
  WHEN signal_kind IN ('mpzp_project', 'planning_resolution') AND signal_status <> 'heuristic' THEN CASE WHEN {D} IN ({quoted(p.POSITIVE)}) THEN 10 ELSE 0 END
  WHEN {D} NOT IN ({quoted(p.POSITIVE)}) THEN 0 WHEN signal_kind = 'pog_zone' THEN 55 WHEN signal_kind = 'pog_ouz' THEN 30 WHEN signal_kind = 'studium_zone' THEN 20 ELSE 0 END"""
LABEL = "signal_kind || ': ' || coalesce(designation_normalized, 'unknown') || CASE WHEN coalesce(plan_name, '') <> '' THEN ' (' || plan_name || ')' ELSE '' END"
SIGNALS = f"WITH {duck('fx_signals')}"
#: Attached signals: those bound to a parcel of the same commune, and every commune-level one of it, one by one.
ATTACHED = f"WITH {duck('fx_signals', 'fx_parcels')}, att AS (SELECT p.parcel_id, s.* EXCLUDE (parcel_id, teryt_gmina), ({WEIGHT})::DECIMAL(6,2) AS weight, {LABEL} AS label FROM fx_parcels p JOIN fx_signals s ON s.teryt_gmina = p.teryt_gmina AND (s.parcel_id = p.parcel_id OR s.parcel_id IS NULL))"


def sides(spark, sf_dir):
    return derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_signals")


@query("i3_signal_weight", f"{SIGNALS} SELECT signal_id, ({WEIGHT})::DECIMAL(6,2) AS weight, {LABEL} AS label FROM fx_signals")
def i3_signal_weight(spark, sf_dir):
    """Weight and label of every signal."""
    return ops.weighed(derived(spark, sf_dir, "fx_signals")).select("signal_id", "weight", "label")


@query("i2_designation_class")
def i2_designation_class(spark, sf_dir):
    """Designation class of every zone from symbol and description (I2); held against a table of cases in the tests."""
    zones = derived(spark, sf_dir, "fx_zones")
    words = F.element_at(F.array(*map(F.lit, ("centrum usług", "droga lokalna", "lasy ochronne", "teren Z14.1UP-UC", ""))), (F.col("zone_id") % 5 + 1).cast("int"))
    return zones.select("zone_id", p.designation_class(F.col("symbol"), words).alias("designation"))


@query("c10_attach_signals", f"{ATTACHED} SELECT parcel_id, count(*) AS n, sum(signal_id) AS s FROM att GROUP BY parcel_id")
def c10_attach_signals(spark, sf_dir):
    """Signals attached to parcels by parcel or commune."""
    return ops.count_signals(*sides(spark, sf_dir))


@query(
    "d15_score_signals",
    f"""{ATTACHED} SELECT parcel_id, sum(weight) AS signal_score, coalesce(count_if(weight > 0), 0) AS positive_signals,
  coalesce(bool_or(signal_kind IN ('pog_zone', 'pog_ouz', 'studium_zone') AND weight > 0), FALSE) AS has_formal_signal, coalesce(bool_or(signal_kind IN ('planning_resolution', 'mpzp_project') AND weight > 0), FALSE) AS has_supporting_formal_signal,
  coalesce(bool_or(weight < 0 AND designation_normalized IN ({quoted(p.HARD_NEGATIVE)})), FALSE) AS hard_negative,
  first(label ORDER BY weight DESC, signal_id) FILTER (WHERE weight > 0) AS dominant_signal FROM att GROUP BY parcel_id""",
)
def d15_score_signals(spark, sf_dir):
    """Score, counts, flags and dominant label of each parcel's signals."""
    return ops.score_signals(*sides(spark, sf_dir))


@query(
    "d16_corroborate",
    f"""{ATTACHED}, k AS (SELECT DISTINCT parcel_id, designation_normalized AS d, coalesce(source_url, plan_name, signal_id::VARCHAR) AS s FROM att WHERE signal_kind IN ('planning_resolution', 'mpzp_project') AND designation_normalized IN ({quoted(p.POSITIVE)}) AND weight > 0),
c AS (SELECT parcel_id, d, count(*) AS n FROM k GROUP BY parcel_id, d HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY n DESC, d) = 1),
f AS (SELECT parcel_id, count(DISTINCT s) AS n FROM k GROUP BY parcel_id HAVING count(DISTINCT s) >= 3)
SELECT parcel_id, coalesce(c.d, 'urbanizable') AS designation, coalesce(c.n, f.n) AS n_sources, 10 AS bonus FROM f LEFT JOIN c USING (parcel_id)""",
)
def d16_corroborate(spark, sf_dir):
    """Parcels whose supporting signals corroborate each other."""
    return ops.corroborate(*sides(spark, sf_dir))


PRICES = "SELECT teryt_gmina, price_per_m2_zl::DOUBLE AS price_per_m2 FROM fx_leads WHERE price_per_m2_zl IS NOT NULL"
BENCH = f"""WITH {duck('fx_leads')}, pr AS ({PRICES}), m AS (
  SELECT 'gmina' AS scope, teryt_gmina AS code, price_per_m2 FROM pr UNION ALL SELECT 'powiat', substr(teryt_gmina, 1, 4), price_per_m2 FROM pr UNION ALL SELECT 'wojewodztwo', substr(teryt_gmina, 1, 2), price_per_m2 FROM pr),
b AS (SELECT scope, code, count(*) AS sample_size, quantile_cont(price_per_m2, 0.25) AS p25, quantile_cont(price_per_m2, 0.4) AS p40, quantile_cont(price_per_m2, 0.5) AS median FROM m GROUP BY ALL)"""


def benchmark(spark, sf_dir):
    return ops.market_benchmark(derived(spark, sf_dir, "fx_leads").select("teryt_gmina", F.col("price_per_m2_zl").cast("double").alias("price_per_m2")))


@query("d4_market_benchmark", f"{BENCH} SELECT scope, code, sample_size, round(p25, 4) AS p25, round(p40, 4) AS p40, round(median, 4) AS median FROM b")
def d4_market_benchmark(spark, sf_dir):
    """Price percentiles of communes, counties and provinces."""
    return benchmark(spark, sf_dir).select("scope", "code", "sample_size", *(F.round(c, 4).alias(c) for c in ("p25", "p40", "median")))


@query(
    "i12_cheapness",
    f"""{BENCH} SELECT lead_id, g.scope, CASE WHEN price_per_m2_zl IS NULL THEN 0 WHEN price_per_m2_zl <= p25 THEN 20 WHEN price_per_m2_zl <= p40 THEN 10 ELSE 0 END AS points,
  CASE WHEN sample_size >= 5 AND median > 0 THEN round((median - price_per_m2_zl::DOUBLE) / median * 100, 2) END AS delta_pct FROM fx_leads l JOIN b g ON g.scope = 'gmina' AND g.code = l.teryt_gmina""",
)
def i12_cheapness(spark, sf_dir):
    """Cheapness points and distance from the median of every lead."""
    rows = ops.with_benchmark(derived(spark, sf_dir, "fx_leads").select("lead_id", "teryt_gmina", "price_per_m2_zl"), benchmark(spark, sf_dir))
    price = F.col("price_per_m2_zl").cast("double")
    return rows.select("lead_id", "scope", p.cheapness(price, F.col("sample_size"), F.col("p25"), F.col("p40")).cast("int").alias("points"), ops.benchmark_delta(price, F.col("sample_size"), F.col("p25"), F.col("p40"), F.col("median")).alias("delta_pct"))


@query("d8_signal_mix", f"{SIGNALS} SELECT teryt_gmina, count(*) AS n, coalesce(count_if(designation_normalized IN ({quoted(p.POSITIVE)})), 0) AS positive, count_if(coalesce(designation_normalized, 'unknown') = 'unknown') AS unknown, coalesce(count_if(designation_normalized IN ({quoted(p.HARD_NEGATIVE)})), 0) AS hard_negative FROM fx_signals GROUP BY teryt_gmina")
def d8_signal_mix(spark, sf_dir):
    """Signals of each commune by effect."""
    return ops.signal_mix(derived(spark, sf_dir, "fx_signals"))


@query("d9_max_score", f"WITH {duck('fx_leads')} SELECT teryt_gmina, max(overall_score) AS max_score FROM fx_leads GROUP BY teryt_gmina")
def d9_max_score(spark, sf_dir):
    """Best overall score of each commune."""
    return derived(spark, sf_dir, "fx_leads").groupBy("teryt_gmina").agg(F.max("overall_score").alias("max_score"))


@query("d10_signal_coverage", f"{SIGNALS} SELECT substr(teryt_gmina, 1, 2) AS province, signal_kind, source_type, count(*) AS n FROM fx_signals GROUP BY ALL")
def d10_signal_coverage(spark, sf_dir):
    """Signals by province, kind and source type."""
    return derived(spark, sf_dir, "fx_signals").groupBy(F.substring("teryt_gmina", 1, 2).alias("province"), "signal_kind", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query("d11_freshness", f"{SIGNALS} SELECT source_type, count(*) AS n, max(created_at)::TIMESTAMP AS newest, floor((epoch(TIMESTAMP '2030-01-01') - epoch(max(created_at)::TIMESTAMP)) / 3600)::BIGINT AS age_hours FROM fx_signals GROUP BY source_type")
def d11_freshness(spark, sf_dir):
    """Age of the newest signal of each source type."""
    return ops.freshness(derived(spark, sf_dir, "fx_signals").withColumn("created_at", F.col("created_at").cast("timestamp")), "source_type", "created_at", F.to_timestamp(F.lit("2030-01-01")))


@query("d12_known_sources", f"{SIGNALS} SELECT teryt_gmina, string_agg(DISTINCT source_type, ', ' ORDER BY source_type) AS sources, max(created_at) AS last_sync FROM fx_signals GROUP BY teryt_gmina")
def d12_known_sources(spark, sf_dir):
    """Source types of each commune in one string."""
    return ops.known_sources(derived(spark, sf_dir, "fx_signals"))


@query("d13_future_leads", f"WITH {duck('fx_leads')} SELECT substr(teryt_gmina, 1, 2) AS province, coalesce(confidence_band, 'unclassified') AS band, count(*) AS n FROM fx_leads WHERE strategy_type = 'future_buildable' GROUP BY ALL")
def d13_future_leads(spark, sf_dir):
    """Future leads by province and band."""
    rows = derived(spark, sf_dir, "fx_leads").filter("strategy_type = 'future_buildable'")
    return rows.groupBy(F.substring("teryt_gmina", 1, 2).alias("province"), F.coalesce("confidence_band", F.lit("unclassified")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("d14_near_threshold", f"WITH {duck('fx_leads')} SELECT teryt_gmina, count(DISTINCT parcel_id) AS parcels, max(overall_score) AS max_score FROM fx_leads WHERE overall_score BETWEEN 20 AND 60 GROUP BY teryt_gmina ORDER BY parcels DESC, max_score DESC, teryt_gmina LIMIT 20")
def d14_near_threshold(spark, sf_dir):
    """The twenty communes with most parcels just below the threshold."""
    rows = derived(spark, sf_dir, "fx_leads").filter("overall_score BETWEEN 20 AND 60").groupBy("teryt_gmina").agg(F.countDistinct("parcel_id").alias("parcels"), F.max("overall_score").alias("max_score"))
    return rows.orderBy(F.desc("parcels"), F.desc("max_score"), "teryt_gmina").limit(20)


@query(
    "d5_coverage_target",
    f"""WITH {duck('fx_parcels', 'fx_loaded', 'fx_open_leads')}, g AS (SELECT DISTINCT teryt_gmina AS g FROM fx_parcels),
  j AS (SELECT substr(g, 1, 2) AS province, g IN (SELECT teryt_gmina FROM fx_loaded) AS z, g IN (SELECT teryt_gmina FROM fx_open_leads) AS l FROM g),
  c AS (SELECT province, count(*) AS n_gminas, count_if(z) AS covered, count_if(l) AS with_leads FROM j GROUP BY province)
SELECT *, round(100.0 * covered / n_gminas, 1) AS coverage_pct, ceil(n_gminas * 0.7)::BIGINT AS target, greatest(ceil(n_gminas * 0.7)::BIGINT - covered, 0) AS gap FROM c""",
)
def d5_coverage_target(spark, sf_dir):
    """Covered communes of each province and the gap to the target."""
    return ops.coverage_target(derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_loaded"), derived(spark, sf_dir, "fx_open_leads"))


CORPUS = "corpus AS (SELECT lead_id AS parcel_id, CASE lead_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'uncertain' END AS label, overall_score FROM (SELECT lead_id, (lead_id * 13 % 101)::DOUBLE AS overall_score FROM fx_leads))"


@query(
    "d21_calibrate",
    f"""WITH {duck('fx_leads')}, {CORPUS}, t AS (SELECT unnest([40.0, 50.0, 60.0])::DOUBLE AS threshold),
  c AS (SELECT threshold, count_if(overall_score >= threshold AND label = 'positive') AS tp, count_if(overall_score >= threshold AND label <> 'positive') AS fp, count_if(overall_score < threshold AND label = 'positive') AS fn FROM corpus, t GROUP BY threshold)
SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall FROM c""",
)
def d21_calibrate(spark, sf_dir):
    """Precision and recall at three thresholds against labels."""
    rows = derived(spark, sf_dir, "fx_leads").select(F.col("lead_id").alias("parcel_id"))
    label = F.element_at(F.array(*map(F.lit, ("positive", "negative", "uncertain"))), (F.col("parcel_id") % 3 + 1).cast("int"))
    return ops.calibrate(rows.withColumn("label", label), rows.withColumn("overall_score", (F.col("parcel_id") * 13 % 101).cast("double")), [40.0, 50.0, 60.0])


H = {
    "distance_to_nearest_buildable_m": "lead_id % 120", "adjacent_buildable_pct": "lead_id % 51", "shared_boundary_m": "lead_id % 17",
    "distance_to_mixed_service_zone_m": "lead_id % 201", "distance_to_meaningful_road_m": "lead_id % 91", "has_road_access_signal": "lead_id % 2 = 0", "has_urban_cluster_signal": "lead_id % 3 = 0",
}
HEUR = f"WITH {duck('fx_leads')}, h AS (SELECT lead_id, overall_score, future_signal_score, cheapness_score, " + ", ".join(f"{e} AS {c}" for c, e in H.items()) + " FROM fx_leads WHERE strategy_type = 'future_buildable')"
RULES = [(10, "distance_to_nearest_buildable_m <= 50"), (10, "adjacent_buildable_pct >= 25"), (12, "shared_boundary_m >= 8"), (8, "distance_to_mixed_service_zone_m <= 100"), (6, "distance_to_meaningful_road_m <= 60"), (5, "has_road_access_signal"), (10, "has_urban_cluster_signal"), (8, "shared_boundary_m > 0 AND distance_to_nearest_buildable_m <= 25 AND has_urban_cluster_signal")]
BONUS = " + ".join(f"CASE WHEN {t} THEN {n} ELSE 0 END" for n, t in RULES)
HITS = " + ".join(f"({t})::INT" for _, t in RULES)


def heuristics(spark, sf_dir):
    rows = derived(spark, sf_dir, "fx_leads").filter("strategy_type = 'future_buildable'")
    return rows.selectExpr("lead_id", "overall_score", "future_signal_score", "cheapness_score", *(f"{e} AS {c}" for c, e in H.items()))


@query("i13_spatial_heuristics", f"{HEUR} SELECT lead_id, ({BONUS})::DECIMAL(6,2) AS bonus, {HITS} AS hits FROM h")
def i13_spatial_heuristics(spark, sf_dir):
    """Points and hits of the eight spatial rules."""
    return heuristics(spark, sf_dir).select("lead_id", p.heuristic_bonus().alias("bonus"), p.heuristic_hits().alias("hits"))


@query(
    "i14_confidence_band",
    f"""{HEUR}, b AS (SELECT *, {HITS} AS hits, lead_id % 4 = 1 AS f, lead_id % 4 > 1 AS s, lead_id % 5 = 0 AS c, lead_id % 7 = 0 AS neg, lead_id % 19 = 0 AS unk, lead_id % 23 > 0 AS ok FROM h)
SELECT lead_id, CASE WHEN NOT ok OR unk THEN NULL WHEN overall_score >= 60 AND f THEN 'formal' WHEN overall_score >= 60 AND s AND future_signal_score >= 40 AND (hits >= 2 OR c) AND NOT neg THEN 'supported'
  WHEN overall_score >= 60 AND hits >= 2 AND NOT neg THEN 'speculative' WHEN overall_score >= 60 THEN NULL WHEN overall_score >= 55 AND future_signal_score >= 58 AND f AND hits >= 5 AND NOT neg THEN 'supported'
  WHEN overall_score >= 30 AND cheapness_score >= 20 AND future_signal_score >= 10 AND s AND NOT neg THEN 'supported' END AS band FROM b""",
)
def i14_confidence_band(spark, sf_dir):
    """Confidence band of every future lead."""
    flags = heuristics(spark, sf_dir).withColumn("heuristic_hits", p.heuristic_hits()).selectExpr(
        "*", "lead_id % 4 = 1 AS has_formal_signal", "lead_id % 4 > 1 AS has_supporting_formal_signal", "lead_id % 5 = 0 AS has_corroborated_supporting_signal", "lead_id % 7 = 0 AS hard_negative",
        "lead_id % 19 = 0 AS dominant_unknown_resolution", "CASE WHEN lead_id % 23 > 0 THEN 'non_buildable' ELSE 'mixed' END AS current_buildable_status",
    )
    return flags.select("lead_id", p.confidence_band().alias("band"))


@query("e3_best_candidate", f"WITH {duck('fx_leads')} SELECT teryt_gmina, lead_id, overall_score FROM fx_leads WHERE overall_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY teryt_gmina ORDER BY overall_score DESC, lead_id) = 1")
def e3_best_candidate(spark, sf_dir):
    """The best scored lead of each commune."""
    w = Window.partitionBy("teryt_gmina").orderBy(F.desc("overall_score"), "lead_id")
    return derived(spark, sf_dir, "fx_leads").filter("overall_score IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("teryt_gmina", "lead_id", "overall_score")


@query("f7_list_signals", f"{SIGNALS} SELECT signal_id, ({WEIGHT})::DECIMAL(6,2) AS weight FROM fx_signals WHERE signal_kind = 'pog_zone' AND teryt_gmina LIKE '24%' ORDER BY weight DESC, created_at DESC, signal_id LIMIT 100")
def f7_list_signals(spark, sf_dir):
    """Filtered signals, heaviest and newest first."""
    rows = ops.weighed(derived(spark, sf_dir, "fx_signals").filter("signal_kind = 'pog_zone' AND teryt_gmina LIKE '24%'"))
    return rows.orderBy(F.desc("weight"), F.desc("created_at"), "signal_id").limit(100).select("signal_id", "weight")
