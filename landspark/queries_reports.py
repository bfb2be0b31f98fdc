"""Registered queries of reports, collections, colours and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landspark.fixtures import derived, duck, duck_edges
from landspark.functions import geometry as g
from landspark.operators import leads as lead_ops
from landspark.operators import reports as ops
from landspark.queries import AREA, query
from landspark.queries_tables import CATEGORY

LEADS, SIGNALS, ZONES = (f"WITH {duck(n)}" for n in ("fx_leads", "fx_signals", "fx_zones"))


@query("b16_collect_polygons", f"WITH {duck('fx_parcels')}, {duck_edges('e', 'fx_parcels', 'parcel_id')} SELECT teryt_gmina, count(DISTINCT parcel_id) AS n_parts, round({AREA}, 2) AS area FROM e JOIN fx_parcels USING (parcel_id) GROUP BY teryt_gmina")
def b16_collect_polygons(spark, sf_dir):
    """Number and area of each commune's polygons, summed before any of them are put together."""
    return ops.sum_polygons(derived(spark, sf_dir, "fx_parcels"), ["teryt_gmina"])


@query("b18_dedup_tiled", f"{ZONES} SELECT zone_id, 0 AS tile, symbol FROM fx_zones")
def b18_dedup_tiled(spark, sf_dir):
    """Zones that two tiles brought, once."""
    zones = derived(spark, sf_dir, "fx_zones")
    twice = zones.withColumn("tile", F.lit(0)).unionByName(zones.filter("plan_type = 'pog'").withColumn("tile", F.lit(1)))
    return ops.dedup_tiled(twice, [F.asc("tile"), F.asc("zone_id")]).select("zone_id", "tile", "symbol")


PIXELS = "WITH px AS (SELECT vec_id, (abs(embedding[1]) * 255)::INT % 256 AS r, (abs(embedding[2]) * 255)::INT % 256 AS g, (abs(embedding[3]) * 255)::INT % 256 AS b FROM embeddings WHERE embedding IS NOT NULL)"
COLOURS = [("MN", "zabudowa mieszkaniowa", 240, 200, 60), ("U", "usługi", 220, 40, 40), ("ZL", "lasy", 20, 120, 30), ("WS", "wody", 40, 90, 220), ("KD", "drogi", 250, 250, 250), ("R", "role", 200, 220, 120)]


def pixels(spark, sf_dir):
    part = lambda i: (F.floor(F.abs(F.get("embedding", F.lit(i)).cast("double")) * 255 + 0.5).cast("int") % 256)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding IS NOT NULL").select("vec_id", part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


PIXELS = PIXELS.replace("(abs(embedding[1]) * 255)::INT", "floor(abs(embedding[1]::DOUBLE) * 255 + 0.5)::INT").replace("(abs(embedding[2]) * 255)::INT", "floor(abs(embedding[2]::DOUBLE) * 255 + 0.5)::INT").replace("(abs(embedding[3]) * 255)::INT", "floor(abs(embedding[3]::DOUBLE) * 255 + 0.5)::INT")


@query(
    "c20_classify_colours",
    PIXELS + ", lg AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{x}', {r}, {gg}, {b})" for d, x, r, gg, b in COLOURS) + """) t(designation, label, lr, lg, lb)),
c AS (SELECT vec_id AS id, designation, CASE WHEN vec_id % 4 = 0 AND designation = 'U' THEN 0 WHEN vec_id % 4 = 0 AND label LIKE '%u%' THEN 1 ELSE 2 END AS tier, sqrt(((r - lr) * (r - lr) + (g - lg) * (g - lg) + (b - lb) * (b - lb))::DOUBLE) AS d FROM px, lg)
SELECT id, designation, round(1 - d / sqrt(3.0 * 255 * 255), 4) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, d, designation) = 1""",
)
def c20_classify_colours(spark, sf_dir):
    """Nearest legend colour of each sample, hints first (C20)."""
    legend = spark.createDataFrame(COLOURS, "designation string, label string, r int, g int, b int")
    return ops.classify_colours(pixels(spark, sf_dir).select(F.col("vec_id").alias("id"), "r", "g", "b", F.when(F.col("vec_id") % 4 == 0, "U").alias("hint")), legend)


@query(
    "d27_dominant_colour",
    PIXELS + ", q AS (SELECT vec_id % 20 AS k, r // 32 * 32 AS r, g // 32 * 32 AS g, b // 32 * 32 AS b FROM px), n AS (SELECT k, r, g, b, count(*) AS n FROM q GROUP BY ALL) SELECT k, r, g, b, n FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY NOT (greatest(r, g, b) - least(r, g, b) <= 12 AND (greatest(r, g, b) >= 245 OR greatest(r, g, b) <= 30)) DESC, n DESC, greatest(r, g, b) - least(r, g, b) DESC, r + g + b DESC, r DESC, g DESC, b DESC) = 1",
)
def d27_dominant_colour(spark, sf_dir):
    """Dominant colour of groups of pixels."""
    coarse = lambda c: (F.floor(F.col(c) / 32) * 32).cast("int").alias(c)
    return ops.dominant_colour(pixels(spark, sf_dir).select((F.col("vec_id") % 20).alias("k"), coarse("r"), coarse("g"), coarse("b")), "k")


@query("a13_run_ledger", "WITH e AS (SELECT user_id AS run_id, event_type <> 'error' AS ok FROM events) SELECT run_id, count_if(ok) AS saved, count(*) - count_if(ok) AS failed, CASE WHEN count_if(ok) < count(*) AND count_if(ok) = 0 THEN 'failed' WHEN count_if(ok) < count(*) THEN 'partial' ELSE 'completed' END AS status FROM e GROUP BY run_id")
def a13_run_ledger(spark, sf_dir):
    """Runs closed with their counts and state."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("at"))
    return ops.run_ledger(events).select("run_id", "saved", "failed", "status")


@query("a9_load_current_use", "WITH c AS (SELECT (o_orderkey % 9000)::VARCHAR AS i, CASE WHEN o_orderkey % 13 = 0 THEN 'R1;' ELSE 'R' END AS u FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY i) AS k FROM c) SELECT i AS identyfikator, u AS current_use, CASE WHEN k > 1 THEN 'repeated_id' WHEN u <> 'R' THEN 'bad_code' ELSE 'accepted' END AS outcome FROM n")
def a9_load_current_use(spark, sf_dir):
    """Reviewed land uses accepted and rejected, by reason."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 9000).cast("string").alias("identyfikator"), F.when(F.col("o_orderkey") % 13 == 0, "R1;").otherwise("R").alias("current_use"))
    good, bad = ops.load_current_use(rows)
    return good.withColumn("outcome", F.lit("accepted")).unionByName(bad.withColumnRenamed("reason", "outcome"))


TIER = "CASE WHEN confidence_band = 'formal' THEN 'formal' WHEN confidence_band = 'supported' THEN 'supported' WHEN confidence_band = 'speculative' OR lead_id % 4 = 0 THEN 'below_threshold' WHEN lead_id % 4 = 1 THEN 'blocked' ELSE 'below_threshold' END"


@query(
    "i15_explain_lead",
    f"""{LEADS}, t AS (SELECT lead_id, {TIER} AS tier, dominant_future_signal FROM fx_leads WHERE strategy_type = 'future_buildable')
SELECT lead_id, tier, CASE WHEN tier = 'formal' THEN '{ops.ACTIONS['formal']}' WHEN tier = 'supported' THEN '{ops.ACTIONS['supported']}' WHEN lead_id % 4 = 1 THEN '{ops.ACTIONS['negative']}' WHEN lead_id % 4 = 0 THEN '{ops.ACTIONS['geometry']}' WHEN dominant_future_signal IS NOT NULL THEN '{ops.ACTIONS['dominant']}' ELSE '{ops.ACTIONS['research']}' END AS action FROM t""",
)
def i15_explain_lead(spark, sf_dir):
    """Signal tier and next step of every future lead."""
    signal = lambda kind, d, w: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(d).alias("designation_normalized"), F.lit(w).alias("weight")))
    kind = F.when(F.col("lead_id") % 4 == 0, signal("planning_resolution", "service", 10.0)).when(F.col("lead_id") % 4 == 1, signal("pog_zone", "forest", -40.0)).otherwise(signal("mpzp_project", "unknown", 0.0))
    rows = derived(spark, sf_dir, "fx_leads").filter("strategy_type = 'future_buildable'").withColumn("sb", kind)
    args = (F.col("strategy_type"), F.col("confidence_band"), F.col("sb"))
    return rows.select("lead_id", ops.signal_tier(*args).alias("tier"), ops.next_action(*args, F.col("dominant_future_signal")).alias("action"))


@query("d26_coverage_categories", f"WITH {duck('fx_parcels')}, g AS (SELECT teryt_gmina, count(*) AS n FROM fx_parcels GROUP BY 1) SELECT CASE WHEN teryt_gmina LIKE '%1' THEN 'manual_only' WHEN substr(teryt_gmina, 3, 2) > '10' THEN 'source_configured' ELSE 'no_source' END AS category, sum(n)::BIGINT AS parcels FROM g GROUP BY 1")
def d26_coverage_categories(spark, sf_dir):
    """Parcels of uncovered communes by category, overrides first."""
    rows = derived(spark, sf_dir, "fx_parcels").groupBy("teryt_gmina").agg(F.count(F.lit(1)).alias("n")).withColumn("in_registry", F.substring("teryt_gmina", 3, 2) > "10")
    overrides = rows.filter("teryt_gmina LIKE '%1'").select("teryt_gmina", F.lit("manual_only").alias("category"))
    return ops.coverage_category(rows, overrides).groupBy("category").agg(F.sum("n").alias("parcels"))


@query("i26_suggest_label", f"{LEADS} SELECT CASE WHEN lead_id % 9 = 0 THEN 'negative' WHEN confidence_band IN ('formal', 'supported') OR overall_score >= 60 THEN 'positive' WHEN overall_score < 20 THEN 'negative' ELSE 'uncertain' END AS label, count(*) AS n FROM fx_leads GROUP BY 1")
def i26_suggest_label(spark, sf_dir):
    """Suggested review labels."""
    return derived(spark, sf_dir, "fx_leads").groupBy(ops.suggest_label(F.col("overall_score"), F.col("lead_id") % 9 == 0, F.col("confidence_band")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("j6_refresh_signals", f"{SIGNALS} SELECT signal_id, source_type, FALSE AS fresh FROM fx_signals WHERE source_type <> 'html' UNION ALL SELECT signal_id, source_type, TRUE FROM fx_signals WHERE source_type = 'html' AND signal_id % 2 = 0")
def j6_refresh_signals(spark, sf_dir):
    """Managed signals give way to fresh ones."""
    rows = derived(spark, sf_dir, "fx_signals").select("signal_id", "teryt_gmina", "source_type").withColumn("fresh", F.lit(False))
    fresh = rows.filter("source_type = 'html' AND signal_id % 2 = 0").withColumn("fresh", F.lit(True))
    return ops.refresh_signals(rows, fresh, ["html"]).drop("teryt_gmina")


@query("j9_sweep_retry", f"WITH {duck('fx_retry', 'fx_listings')}, q AS (SELECT listing_id, {CATEGORY} AS category FROM fx_retry WHERE listing_id NOT IN (SELECT listing_id FROM fx_listings)) SELECT listing_id, category, category = 'manual_only_case' AS manual FROM q")
def j9_sweep_retry(spark, sf_dir):
    """The queue after a sweep, and what goes to the manual backlog."""
    # as many parts as are set: by their few compressed bytes, parts of bare ids would be put together
    listed = derived(spark, sf_dir, "fx_listings").select("listing_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "listing_id")
    left, manual = ops.sweep_retry(derived(spark, sf_dir, "fx_retry"), listed)
    return left.withColumn("manual", F.lit(False)).unionByName(manual.withColumn("manual", F.lit(True))).select("listing_id", "category", "manual")


@query("f10_scope_parcels", f"WITH {duck('fx_parcels')} SELECT parcel_id FROM fx_parcels WHERE parcel_id IN (1, 2, 3) OR teryt_gmina = '1201011' OR teryt_gmina LIKE '18%'")
def f10_scope_parcels(spark, sf_dir):
    """Parcels named by id, commune or province."""
    return ops.scope_parcels(derived(spark, sf_dir, "fx_parcels"), [1, 2, 3], ["1201011"], ["18"]).select("parcel_id")


@query("f6_top_candidates", f"{LEADS} SELECT lead_id, overall_score FROM fx_leads WHERE strategy_type = 'future_buildable' AND confidence_band IS NULL ORDER BY overall_score DESC, future_signal_score DESC, lead_id LIMIT 10")
def f6_top_candidates(spark, sf_dir):
    """The ten best future leads without a band."""
    rows = derived(spark, sf_dir, "fx_leads").filter("strategy_type = 'future_buildable' AND confidence_band IS NULL")
    return lead_ops.top_by(rows, [F.desc("overall_score"), F.desc("future_signal_score"), F.asc("lead_id")], 10).select("lead_id", "overall_score")


@query("e6_extend_pick", f"{LEADS}, a AS (SELECT lead_id FROM fx_leads WHERE overall_score > 99 ORDER BY lead_id LIMIT 30), b AS (SELECT lead_id FROM fx_leads WHERE lead_id NOT IN (SELECT lead_id FROM a) ORDER BY confidence_score DESC, lead_id LIMIT 5000) SELECT lead_id FROM (SELECT lead_id, 0 AS p, 0 AS r FROM a UNION ALL SELECT lead_id, 1, row_number() OVER (ORDER BY (SELECT confidence_score FROM fx_leads x WHERE x.lead_id = b.lead_id) DESC, lead_id) FROM b) ORDER BY p, r, lead_id LIMIT 60")
def e6_extend_pick(spark, sf_dir):
    """A selection filled up from a second pool."""
    rows = derived(spark, sf_dir, "fx_leads").select("lead_id", "overall_score", "confidence_score")
    picked = rows.filter("overall_score > 99").orderBy("lead_id").limit(30)
    return lead_ops.extend_pick(picked, rows, "lead_id", [F.desc("confidence_score"), F.asc("lead_id")], 60).select("lead_id")


CENTROID = f"""c AS (SELECT parcel_id, 500000 + sum(((x1-500000)+(x2-500000)) * ((x2-500000)*(y1-300000) - (x1-500000)*(y2-300000)) / 6) / {AREA} AS cx,
  300000 + sum(((y1-300000)+(y2-300000)) * ((x2-500000)*(y1-300000) - (x1-500000)*(y2-300000)) / 6) / {AREA} AS cy FROM e GROUP BY parcel_id)"""


@query(
    "c5_plan_extents",
    f"""WITH {duck('fx_parcels', 'fx_zones')}, {duck_edges('e', 'fx_parcels', 'parcel_id')}, {CENTROID}, pp AS (SELECT * FROM c JOIN fx_parcels USING (parcel_id)),
b AS (SELECT zone_id, teryt_gmina, x0 - 3000 AS minx, x0 + w + 3000 AS maxx, y0 - 3000 AS miny, y0 + h + 3000 AS maxy FROM fx_zones)
SELECT b.teryt_gmina, zone_id, coalesce(count_if(cx BETWEEN minx AND maxx AND cy BETWEEN miny AND maxy), 0) AS n_hits, coalesce(count_if(cy BETWEEN minx AND maxx AND cx BETWEEN miny AND maxy), 0) AS n_swapped_hits, FALSE AS bbox_axes_suspect FROM b JOIN pp USING (teryt_gmina) GROUP BY b.teryt_gmina, zone_id""",
)
def c5_plan_extents(spark, sf_dir):
    """Parcels whose interior point lies in a plan's extent, grown by 3 km."""
    from landspark.operators.spatial import match_plan_extents

    grown = F.transform("geom", lambda a: F.transform(a, lambda r: F.transform(r, lambda v: F.struct((F.when(v["x"] == F.col("x0"), v["x"] - 3000).when(v["x"] == F.col("x0") + F.col("w"), v["x"] + 3000).otherwise(v["x"])).alias("x"), (F.when(v["y"] == F.col("y0"), v["y"] - 3000).when(v["y"] == F.col("y0") + F.col("h"), v["y"] + 3000).otherwise(v["y"])).alias("y")))))
    return match_plan_extents(derived(spark, sf_dir, "fx_parcels"), derived(spark, sf_dir, "fx_zones").withColumn("geom", grown))


@query(
    "d25_cluster_summary",
    f"WITH {duck('fx_parcels', 'fx_listings', 'fx_leads')}, s AS (SELECT * FROM fx_parcels WHERE substr(teryt_gmina, 1, 4) IN ('1203', '1806', '2405')) SELECT s.teryt_gmina, count(DISTINCT s.parcel_id) AS parcels, count(DISTINCT l.listing_id) AS listings, count(DISTINCT CASE WHEN l.source_url LIKE '%budowlane%' THEN l.listing_id END) AS building_listings, count(DISTINCT d.lead_id) AS leads FROM s LEFT JOIN fx_listings l USING (parcel_id) LEFT JOIN fx_leads d ON d.parcel_id = s.parcel_id GROUP BY s.teryt_gmina",
)
def d25_cluster_summary(spark, sf_dir):
    """Parcels, linked listings and leads of a cluster of counties; sides are counted before they are joined."""
    parcels = derived(spark, sf_dir, "fx_parcels").filter(F.substring("teryt_gmina", 1, 4).isin("1203", "1806", "2405")).select("parcel_id", "teryt_gmina")
    listings = derived(spark, sf_dir, "fx_listings").groupBy("parcel_id").agg(F.countDistinct("listing_id").alias("l"), F.countDistinct(F.when(F.col("source_url").contains("budowlane"), F.col("listing_id"))).alias("b"))
    leads = derived(spark, sf_dir, "fx_leads").groupBy("parcel_id").agg(F.countDistinct("lead_id").alias("d"))
    rows = parcels.join(listings, "parcel_id", "left").join(leads, "parcel_id", "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return rows.groupBy("teryt_gmina").agg(F.count(F.lit(1)).alias("parcels"), total("l", "listings"), total("b", "building_listings"), total("d", "leads"))


@query(
    "k9_red_team",
    f"{LEADS}, s AS (SELECT 'low_score_banded' AS section, lead_id, overall_score FROM fx_leads WHERE overall_score < 40 AND confidence_band IS NOT NULL UNION ALL SELECT 'high_score_unbanded', lead_id, overall_score FROM fx_leads WHERE overall_score >= 60 AND confidence_band IS NULL UNION ALL SELECT 'cheap_without_signal', lead_id, overall_score FROM fx_leads WHERE cheapness_score >= 20 AND future_signal_score < 10) SELECT section, lead_id FROM s QUALIFY row_number() OVER (PARTITION BY section ORDER BY overall_score DESC, lead_id) <= 10",
)
def k9_red_team(spark, sf_dir):
    """Ten doubtful leads of each of three kinds (K9)."""
    rows = derived(spark, sf_dir, "fx_leads").select("lead_id", "overall_score", "confidence_band", "cheapness_score", "future_signal_score")
    kinds = {"low_score_banded": "overall_score < 40 AND confidence_band IS NOT NULL", "high_score_unbanded": "overall_score >= 60 AND confidence_band IS NULL", "cheap_without_signal": "cheapness_score >= 20 AND future_signal_score < 10"}
    tagged = rows.withColumn("section", F.explode(F.array_compact(F.array(*(F.when(F.expr(test), name) for name, test in kinds.items())))))
    w = Window.partitionBy("section").orderBy(F.desc("overall_score"), "lead_id")
    return tagged.withColumn("_n", F.row_number().over(w)).filter("_n <= 10").select("section", "lead_id")
