"""Registered queries of streams: each reads a table's files as a stream, all that is there, and returns what its log says."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import LEADS, duck, pick, spark_sql
from landspark.queries import query
from landspark.storage import new_path
from landspark.streaming import jobs, stateful

ERRORS = pick("event_id % 5", "ULDK_NOT_FOUND: no parcel", "GEOMETRY_MISSING: empty polygon", "missing parcel number", "no_source_configured", "manual_review_required")


def _stream(spark, sf_dir, name):
    """A table as a file stream: the folder's files of that name, so that a stream can keep its place in them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)


def _logged(changes, name, key):
    """Run a stream over all that is there, and read its log."""
    out = new_path(changes.sparkSession, name)
    stateful.write_log(changes, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return stateful.read_log(changes, f"{out}/log", key)


@query("l1_stream_register", "SELECT DISTINCT user_id, event_type, sha256(user_id::VARCHAR || '|' || event_type) AS hash FROM events")
def l1_stream_register(spark, sf_dir):
    """Events registered once for each user and type by a stream with keyed state (L1)."""
    stream = _stream(spark, sf_dir, "events").select("user_id", "event_type", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("hash"))
    return _logged(jobs.register_exactly(stream, "hash"), "registered", "hash")


@query(
    "l2_stream_second_auctions",
    """WITH l AS (SELECT 'KM ' || l_orderkey AS case_key, l_orderkey * 10 + l_linenumber AS listing_id, l_extendedprice::DECIMAL(14,2) AS price_zl, l_shipdate::TIMESTAMP AS created_at FROM lineitem)
SELECT case_key, min_by(listing_id, (created_at, listing_id)) AS listing_id, max_by(price_zl, (created_at, listing_id, price_zl)) AS price_zl, max(created_at) AS created_at, count(*) AS n_auctions,
  CASE WHEN count(*) > 1 THEN 'requeued' ELSE 'new' END AS status FROM l GROUP BY case_key""",
)
def l2_stream_second_auctions(spark, sf_dir):
    """Repeated auctions of a property as one listing, by a stream with keyed state (L2); E7 as a stream."""
    listings = _stream(spark, sf_dir, "lineitem").selectExpr(
        "concat('KM ', cast(l_orderkey AS string)) AS case_key", "l_orderkey * 10 + l_linenumber AS listing_id", "cast(l_extendedprice AS decimal(14,2)) AS price_zl", "cast(l_shipdate AS timestamp) AS created_at"
    )
    return _logged(stateful.second_auctions(listings), "auctions", "case_key")


@query(
    "l3_stream_retry",
    f"""WITH a AS (SELECT user_id AS listing_id, event_id, ts AS m, event_type = 'error' AS failed, {ERRORS} AS error FROM events WHERE event_type IN ('error', 'purchase') AND user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT listing_id, max(m) FILTER (WHERE NOT failed) AS resolved FROM a GROUP BY listing_id),
f AS (SELECT listing_id, least(count(*), 5) AS n, max(m) AS last, max_by(error, (m, event_id)) AS error FROM a JOIN r USING (listing_id) WHERE failed AND (resolved IS NULL OR m > resolved) GROUP BY listing_id),
d AS (SELECT listing_id, coalesce(n, 0)::INT AS attempt_count, error AS last_error,
        CASE WHEN n >= 5 OR contains(upper(error), 'GEOMETRY_MISSING') THEN TIMESTAMP '9999-12-31' WHEN n > 0 THEN last + to_hours([1, 4, 24, 72][n]) END AS next_retry_at FROM r LEFT JOIN f USING (listing_id))
SELECT listing_id, CASE WHEN attempt_count = 0 THEN 'resolved' WHEN next_retry_at = TIMESTAMP '9999-12-31' THEN 'manual' WHEN next_retry_at < (SELECT max(m) FROM a) - INTERVAL 1 DAY THEN 'due' ELSE 'waiting' END AS status,
  attempt_count, last_error, next_retry_at FROM d""",
)
def l3_stream_retry(spark, sf_dir):
    """The retry queue of failures (errors) and resolutions (purchases), by a stream with keyed state and timers (L3)."""
    attempts = _stream(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')")
    attempts = attempts.selectExpr("user_id AS listing_id", "event_id", "cast(ts AS timestamp) AS at", "event_type = 'error' AS failed", f"{ERRORS} AS error")
    return _logged(stateful.retry_queue(attempts, "1 day"), "retries", "listing_id")


@query("l3_stream_error_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def l3_stream_error_counts(spark, sf_dir):
    """Windowed counts of events by a stream over the table's files; summed, they are the batch's counts."""
    stream = _stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = new_path(spark, "counts")
    last = lambda df, number: df.write.mode("overwrite").parquet(f"{out}/table")
    counts = jobs.stream_error_counts(stream, "at", "30 days", "3650 days")
    counts.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table").groupBy("event_type").agg(F.sum("n").alias("n"))


@query(
    "l4_stream_watchlist",
    f"""WITH {duck('fx_leads')} SELECT lead_id, overall_score, created_at FROM fx_leads
WHERE strategy_type = 'future_buildable' AND coalesce(overall_score, confidence_score * 100) >= 50 AND created_at > TIMESTAMP '1996-06-01' AND contains(upper(trim(coalesce(dominant_future_signal, dominant_przeznaczenie, ''))), 'ZONE')""",
)
def l4_stream_watchlist(spark, sf_dir):
    """Watchlist alerts of a stream of leads (L4)."""
    leads = spark.sql(spark_sql(LEADS).replace("FROM orders", "FROM {base}"), base=_stream(spark, sf_dir, "orders"))
    alerts = jobs.stream_watchlist(leads, F.to_timestamp(F.lit("1996-06-01")), mode="future_buildable", min_confidence_pct=50, min_coverage_pct=30, designation="zone")
    return _logged(alerts.select("lead_id", "overall_score", "created_at"), "alerts", "lead_id")
