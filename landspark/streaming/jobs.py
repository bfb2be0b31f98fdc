"""Structured Streaming jobs: registration of listings, watchlist alerts and running retry counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspark.operators.leads import new_matches, watchlist_match


def stream_register(stream: DataFrame, hash_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each hash within the watermark's delay; state is bounded by the delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([hash_col])


def register_exactly(stream: DataFrame, hash_col: str) -> DataFrame:
    """The first row of each hash for ever.

    Hashes that were seen are state by key, in the RocksDB store on disk, so a micro-batch reads only the hashes that it
    brings.  Write the rows with ``stateful.write_log``, which sets that store.
    """
    return stream.dropDuplicates([hash_col])


def stream_watchlist(stream: DataFrame, acknowledged: Column | None = None, **criteria) -> DataFrame:
    """Alerts: leads of a stream that meet a watchlist's criteria and are newer than its acknowledgement (null: all).

    Stateless, so a lead is reported with each row that it comes with; write alerts with ``stateful.write_log``.
    """
    return new_matches(watchlist_match(stream, **criteria), acknowledged)


def stream_error_counts(stream: DataFrame, time_col: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events by type in windows of event time; late rows count until the watermark passes their window."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window), "event_type").agg(F.count(F.lit(1)).alias("n"))
