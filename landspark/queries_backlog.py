"""Registered queries of backlogs, readiness, page checks, evidence, reviews, back-fill and WKB; all return their rows."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from landspark.fixtures import derived, duck, duck_edges
from landspark.functions import geometry as g
from landspark.operators import backlog as ops
from landspark.operators import places
from landspark.operators.leads import latest_by
from landspark.queries import AREA, query
from landspark.queries_places import ROWS, _notices
from landspark.queries_signals import BENCH, benchmark
from landspark.queries_text import ENT
from landspark.sources import geojson, wkb

#: Source types of communes, and the state of their page indexes, by columns of zones and signals.
BACKLOG = f"""WITH {duck('fx_leads', 'fx_zones', 'fx_signals')},
near AS (SELECT teryt_gmina, count(DISTINCT parcel_id) AS parcel_count, max(overall_score) AS max_overall_score FROM fx_leads WHERE overall_score BETWEEN 20 AND 60 GROUP BY 1),
src AS (SELECT teryt_gmina, list_sort(list(DISTINCT t)) AS known FROM (SELECT teryt_gmina, 'planning_zone_passthrough' AS t FROM fx_zones WHERE symbol = 'MN' UNION ALL SELECT teryt_gmina, 'html_index' FROM fx_signals WHERE signal_kind = 'pog_ouz' AND source_type = 'gison') GROUP BY 1),
prb AS (SELECT teryt_gmina, CASE WHEN count(*) % 3 = 0 THEN 'upstream_broken' ELSE 'live' END AS html_status, CASE WHEN count(*) % 3 = 0 THEN 'no answer' END AS html_error FROM fx_zones WHERE plan_type = 'pog' GROUP BY 1),
bk AS (SELECT *, CASE WHEN html_status = 'upstream_broken' THEN 'manual_research' WHEN known IS NULL THEN 'wykazplanow' WHEN NOT list_contains(known, 'planning_zone_passthrough') THEN 'studium_or_pog_geometry' WHEN list_contains(known, 'html_index') THEN 'mpzp_project_or_resolution' ELSE 'heuristics_tuning' END AS next_best_source_type,
  CASE WHEN html_status = 'upstream_broken' THEN 'upstream_broken' WHEN known IS NULL THEN 'ready' WHEN NOT list_contains(known, 'planning_zone_passthrough') THEN 'needs_geometry_source' WHEN html_status = 'live' THEN 'live' ELSE 'partial' END AS operator_status
  FROM near LEFT JOIN src USING (teryt_gmina) LEFT JOIN prb USING (teryt_gmina))"""


def _backlog(spark, sf_dir):
    leads, zones, found = (derived(spark, sf_dir, n) for n in ("fx_leads", "fx_zones", "fx_signals"))
    near = leads.filter("overall_score BETWEEN 20 AND 60").groupBy("teryt_gmina").agg(F.countDistinct("parcel_id").alias("parcel_count"), F.max("overall_score").alias("max_overall_score"))
    types = zones.filter("symbol = 'MN'").select("teryt_gmina", F.lit(ops.ZONES).alias("t")).union(found.filter("signal_kind = 'pog_ouz' AND source_type = 'gison'").select("teryt_gmina", F.lit(ops.INDEX)))
    broken = F.count(F.lit(1)) % 3 == 0
    probes = zones.filter("plan_type = 'pog'").groupBy("teryt_gmina").agg(F.when(broken, "upstream_broken").otherwise("live").alias("html_status"), F.when(broken, "no answer").alias("html_error"))
    return ops.source_backlog(near, types.groupBy("teryt_gmina").agg(F.collect_set("t").alias("known")), probes)


@query("c21_source_backlog", f"{BACKLOG} SELECT teryt_gmina, parcel_count, max_overall_score, array_to_string(known, ',') AS known_sources, html_status, html_error, next_best_source_type, operator_status FROM bk")
def c21_source_backlog(spark, sf_dir):
    """Communes near the threshold with sources, state of their index, status and advice."""
    return _backlog(spark, sf_dir).select("teryt_gmina", "parcel_count", "max_overall_score", F.array_join("known", ",").alias("known_sources"), "html_status", "html_error", "next_best_source_type", "operator_status")


@query(
    "g4_province_backlog",
    f"""{BACKLOG}, prc AS (SELECT o.teryt_gmina, count(*) AS n FROM ({duck('fx_parcels').split(' AS (', 1)[1][:-1]}) o GROUP BY 1),
gap AS (SELECT teryt_gmina, n FROM prc WHERE teryt_gmina NOT IN (SELECT teryt_gmina FROM fx_zones WHERE symbol = 'MN'))
SELECT 'coverage_gap' AS backlog_family, teryt_gmina, 'no_source' AS bucket, n AS parcel_count, NULL AS max_overall_score, NULL AS operator_status FROM gap
UNION ALL SELECT 'future_signal', teryt_gmina, operator_status, parcel_count, max_overall_score, operator_status FROM bk""",
)
def g4_province_backlog(spark, sf_dir):
    """Coverage gaps and future-signal rows in one table (G4); six of its 17 columns."""
    parcels, zones = derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_zones")
    gaps = parcels.groupBy("teryt_gmina").agg(F.count(F.lit(1)).alias("parcel_count")).join(zones.filter("symbol = 'MN'").select("teryt_gmina"), "teryt_gmina", "left_anti").withColumn("bucket", F.lit("no_source"))
    future = _backlog(spark, sf_dir).withColumn("bucket", F.col("operator_status")).withColumn("known_sources", F.array_join("known", ",")).drop("known")
    return ops.province_backlog(gaps, future).select("backlog_family", "teryt_gmina", "bucket", "parcel_count", "max_overall_score", "operator_status")


@query(
    "k10_benchmark_gaps",
    f"""{BENCH}, c AS (SELECT teryt_gmina, lead_id, overall_score, price_per_m2_zl FROM fx_leads WHERE overall_score >= 20 QUALIFY row_number() OVER (PARTITION BY teryt_gmina ORDER BY overall_score DESC, lead_id) = 1 ORDER BY teryt_gmina LIMIT 20)
SELECT teryt_gmina, lead_id, overall_score, price_per_m2_zl, g.scope AS benchmark_scope, sample_size, sample_size >= 5 AND median IS NOT NULL AS reliable FROM c JOIN b g ON g.scope = 'gmina' AND g.code = teryt_gmina WHERE price_per_m2_zl IS NULL OR sample_size < 5""",
)
def k10_benchmark_gaps(spark, sf_dir):
    """Best candidates whose price or benchmark is missing."""
    rows = ops.benchmark_gaps(derived(spark, sf_dir, "fx_leads").select("teryt_gmina", "lead_id", "overall_score", "price_per_m2_zl"), benchmark(spark, sf_dir), "lead_id")
    return rows.select("teryt_gmina", "lead_id", "overall_score", "price_per_m2_zl", F.col("scope").alias("benchmark_scope"), "sample_size", "reliable")


@query(
    "h22_page_checks",
    f"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\\b.*?</script\\s*>', ' ', 'gis'), '<style\\b.*?</style\\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs') AS h FROM pages),
t AS (SELECT page_id, url, trim(regexp_replace({ENT}, '\\s+', ' ', 'g')) AS x, ['application/pdf', 'text/xml', 'text/html', NULL][page_id % 4 + 1] AS kind FROM a)
SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' OR coalesce(kind, '') = 'application/pdf' THEN 'pdf' WHEN lower(url) LIKE '%.gml' OR coalesce(kind, '') = 'text/xml' THEN 'gml' ELSE 'html_index' END AS source_type,
  CASE WHEN x = '' THEN '{ops.NO_BODY}' WHEN regexp_matches(x, 'błąd połączenia|blad polaczenia|connection error', 'i') THEN '{ops.ERROR_BODY}' || substr(x, 1, 160) END AS error FROM t""",
)
def h22_page_checks(spark, sf_dir):
    """Source type of every page and why it can't be an index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = F.get(F.array(F.lit("application/pdf"), F.lit("text/xml"), F.lit("text/html"), F.lit(None)), (F.col("page_id") % 4).cast("int"))
    return pages.select("page_id", ops.source_type(F.col("url"), kind).alias("source_type"), ops.page_error(F.col("html")).alias("error"))


@query("h26_triage", f"{ROWS} SELECT doc_id, [NULL, NULL, 'low_regex_confidence', 'missing_parcel', 'missing_locality', 'missing_locality'][form + 1] AS reason FROM n")
def h26_triage(spark, sf_dir):
    """Why the extraction of each notice needs a second look."""
    docs = _notices(spark, sf_dir)
    named = places.extract_localities(docs, "listing_id")
    best = places.extract_parcels(docs, "listing_id", localities=named).groupBy("doc_id").agg(F.max_by(F.struct("number", "confidence"), F.struct("confidence", -F.col("offset"))).alias("b"))
    rows = places.extract_precinct(docs, "listing_id", localities=named).join(best, "doc_id", "left")
    return rows.select("doc_id", ops.triage(F.col("b.number"), F.col("b.confidence"), F.col("precinct_raw")).alias("reason"))


@query(
    "d17_evidence_steps",
    f"""WITH {duck('fx_parcels', 'fx_listings', 'fx_signals', 'fx_leads')}, a AS (SELECT DISTINCT parcel_id FROM fx_leads WHERE strategy_type = 'future_buildable'),
l AS (SELECT * FROM fx_listings QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY created_at DESC, listing_id DESC) = 1),
s AS (SELECT parcel_id, 0 AS turn, NULL::TIMESTAMP AS moment, 'source' AS step, listing_id AS ref, source_url AS url FROM l UNION ALL SELECT parcel_id, 1, NULL, 'parcel', parcel_id, NULL FROM fx_parcels
  UNION ALL SELECT parcel_id, 2, created_at::TIMESTAMP, 'signal', signal_id, source_url FROM fx_signals WHERE parcel_id IS NOT NULL UNION ALL SELECT parcel_id, 3, NULL, 'future_assessment', parcel_id, NULL FROM a)
SELECT parcel_id, row_number() OVER (PARTITION BY parcel_id ORDER BY turn, moment, ref)::INT AS position, step, ref::VARCHAR AS ref, url FROM s SEMI JOIN a USING (parcel_id)""",
)
def d17_evidence_steps(spark, sf_dir):
    """The evidence of every assessed parcel, step by step."""
    listings = latest_by(derived(spark, sf_dir, "fx_listings"), "parcel_id", ["created_at"], ["listing_id", "source_url"])
    assessed = derived(spark, sf_dir, "fx_leads").filter("strategy_type = 'future_buildable'").select("parcel_id").distinct()
    return ops.evidence_steps(derived(spark, sf_dir, "fx_parcels"), listings, derived(spark, sf_dir, "fx_signals"), assessed)


@query("j13_backfill_coverage", f"WITH {duck('fx_parcels')}, {duck_edges('e', 'fx_parcels', 'parcel_id')}, a AS (SELECT parcel_id, {AREA} AS area FROM e GROUP BY 1) SELECT teryt_gmina, 'Formal coverage ' || teryt_gmina AS plan_name, 'FORMAL/' || teryt_gmina AS resolution, 'synthetic://formal_backlog/' || teryt_gmina AS source_wfs_url, count(*) AS n_parcels, round(sum(area), 1) AS area FROM fx_parcels JOIN a USING (parcel_id) WHERE teryt_gmina LIKE '12%' GROUP BY 1")
def j13_backfill_coverage(spark, sf_dir):
    """Synthetic zones of one province's communes, their parts summed."""
    parcels = derived(spark, sf_dir, "fx_parcels")
    zones = ops.backfill_coverage(parcels, parcels.select("teryt_gmina").filter("teryt_gmina LIKE '12%'"), "MN", "formal coverage")
    return zones.groupBy("teryt_gmina", "plan_name", "resolution", "source_wfs_url").agg(F.sum("n_parcels").alias("n_parcels"), F.round(F.sum(g.area(F.col("geom"))), 1).alias("area"))


CORPUS = "CASE lead_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'true_positive' WHEN 2 THEN ' true_negative ' WHEN 3 THEN 'tempting_false_positive' WHEN 4 THEN 'positive' ELSE NULL END"


@query("a10_load_corpus", f"WITH {duck('fx_leads')}, r AS (SELECT lead_id::VARCHAR AS parcel_id, trim(coalesce({CORPUS}, '')) AS label, confidence_band AS expected_band FROM fx_leads) SELECT *, CASE WHEN label = '' THEN 'missing_field' WHEN label = 'positive' THEN 'unknown_label' END AS reason FROM r")
def a10_load_corpus(spark, sf_dir):
    """Corpus rows accepted and rejected (A10)."""
    rows = derived(spark, sf_dir, "fx_leads").selectExpr("lead_id AS parcel_id", "substring(teryt_gmina, 1, 2) AS province", f"{CORPUS} AS label", "confidence_band AS expected_band", "status AS notes", "dominant_future_signal AS source_hint")
    good, bad = ops.load_corpus(rows)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("parcel_id", "label", "expected_band", "reason")


LABEL, BAND, NOTES = "CASE status WHEN 'reviewed' THEN ' true_positive ' ELSE '' END", "CASE lead_id % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'formal' ELSE '' END", "CASE status WHEN 'rejected' THEN 'seen' END"


@query(
    "j15_apply_reviews",
    f"""WITH {duck('fx_leads')}, c AS (SELECT lead_id AS parcel_id, 'true_negative' AS label, confidence_band AS expected_band, 'old' AS notes, dominant_future_signal AS source_hint FROM fx_leads WHERE strategy_type = 'future_buildable'),
r AS (SELECT lead_id AS parcel_id, nullif(trim({LABEL}), '') AS l, nullif({BAND}, '') AS b, {NOTES} AS n FROM fx_leads WHERE status <> 'new'), s AS (SELECT * FROM r WHERE coalesce(l, b, n) IS NOT NULL)
SELECT parcel_id, coalesce(l, label) AS label, CASE WHEN b IS NULL THEN expected_band WHEN b <> 'None' THEN b END AS expected_band, coalesce(n, notes) AS notes, source_hint FROM c LEFT JOIN s USING (parcel_id)
UNION ALL SELECT s.parcel_id, l, CASE WHEN b <> 'None' THEN b END, coalesce(n, 'Manual review appended from DB.'), dominant_future_signal FROM s JOIN fx_leads ON lead_id = s.parcel_id WHERE strategy_type <> 'future_buildable'""",
)
def j15_apply_reviews(spark, sf_dir):
    """The corpus after a review, with reviewed parcels that it lacked."""
    leads = derived(spark, sf_dir, "fx_leads")
    corpus = leads.filter("strategy_type = 'future_buildable'").selectExpr("lead_id AS parcel_id", "'true_negative' AS label", "confidence_band AS expected_band", "'old' AS notes", "dominant_future_signal AS source_hint")
    reviews = leads.filter("status <> 'new'").selectExpr("lead_id AS parcel_id", f"{LABEL} AS review_label", f"{BAND} AS review_band", f"{NOTES} AS review_notes")
    return ops.apply_reviews(corpus, reviews, leads.selectExpr("lead_id AS parcel_id", "dominant_future_signal AS source_hint"))


@F.pandas_udf(StringType())
def _hex(x: pd.Series, y: pd.Series) -> pd.Series:
    """Hex WKB of polygons of one ring, to make responses of: little endian where the first x is even, else big endian with an SRID."""

    def one(xs, ys):
        xs, ys = [*xs, xs[0]], [*ys, ys[0]]
        flat = [v for xy in zip(xs, ys) for v in xy]
        if int(xs[0]) % 2 == 0:
            return struct.pack(f"<BIII{len(flat)}d", 1, 3, 1, len(xs), *flat).hex()
        return struct.pack(f">BIIII{len(flat)}d", 0, 3 | wkb.HAS_SRID, 2180, 1, len(xs), *flat).hex()

    return pd.Series([one(*v) for v in zip(x, y)])


@query("b1_decode_wkb", f"WITH {duck('fx_parcels')}, {duck_edges('e', 'fx_parcels', 'parcel_id')}, a AS (SELECT parcel_id, {AREA} AS area FROM e GROUP BY 1) SELECT parcel_id::VARCHAR AS parcel, CASE WHEN current_use IS NOT NULL THEN round(area, 2) END AS area, current_use IS NULL AS rejected FROM fx_parcels JOIN a USING (parcel_id)")
def b1_decode_wkb(spark, sf_dir):
    """Polygons of cadastre responses from hex WKB and EWKB; parcels without a use have a cut text."""
    parcels = derived(spark, sf_dir, "fx_parcels")
    ring = F.col("geom")[0][0]
    coded = parcels.select("parcel_id", "teryt_gmina", "current_use", _hex(F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])).alias("h"))
    line = F.concat_ws("|", F.concat_ws(".", "teryt_gmina", "parcel_id"), F.left("teryt_gmina", F.lit(2)), F.left("teryt_gmina", F.lit(4)), "teryt_gmina", F.lit("0001"), F.col("parcel_id").cast("string"), F.when(F.col("current_use").isNull(), F.left("h", F.lit(30))).otherwise(F.col("h")))
    rows = wkb.decode_wkb(geojson.ingest_cadastre(coded.select(F.col("parcel_id").alias("source_id"), F.concat(F.lit("0\n"), line).alias("body"))))
    return rows.select("parcel", F.round(g.area(F.col("geom")), 2).alias("area"), F.col("geom_error").isNotNull().alias("rejected"))
