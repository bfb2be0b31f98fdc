"""Keyed streams with state and timers: the retry queue with back-off, and second auctions.

What is kept for a key does not depend on the order in which its rows come nor on how they fall into micro-batches: it is
made of extremes and of a bounded number of latest rows.  Each micro-batch appends the rows that changed to a log, in a
folder of its own that a repeated batch overwrites; a table's state is the log's newest row for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from landspark.operators.tables import BACKOFF

#: The store that keyed state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MOST = len(BACKOFF) + 1
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: The last day of the year 9999: never, in microseconds as all times here.
NEVER = 253_402_214_400_000_000

RETRY = "listing_id long, status string, attempt_count int, last_error string, due long"
AUCTIONS = "case_key string, listing_id long, price_zl decimal(14,2), latest long, n_auctions long, status string"


class RetryQueue(StatefulProcessor):
    """The retry queue of one listing.

    State: the time of its last resolution, and its latest failures (time, id), as many as attempts are counted; so a late
    row takes the place that it would have had in time.  A failure after the last resolution makes the listing wait 1, 4, 24
    or 72 hours; the fifth one, or one without a geometry, makes it manual.  A timer fires when a waiting listing is due, and
    another one, ``keep_days`` after its last row, clears the state; a failure after so long a gap is the first one again,
    whether or not the timer has fired by then.
    """

    def __init__(self, keep_days: int):
        self.keep = keep_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queue", "resolved long, times array<long>, ids array<long>, error string, geometry boolean, last long")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at // 1000 + 1)

    @staticmethod
    def _row(key, status: str, n: int, error: str | None, due: int | None) -> pd.DataFrame:
        return pd.DataFrame({"listing_id": [int(key[0])], "status": [status], "attempt_count": [n], "last_error": [error], "due": [due]}, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        resolved, times, ids, error, _, last = self.state.get() if self.state.exists() else (None, [], [], None, False, 0)
        failures, newest = dict(zip(zip(times or [], ids or [], strict=True), [error] * len(times or []), strict=True)), last
        for part in rows:
            newest = max(newest, int(part["micros"].max()))
            for t, i, failed, text in zip(part["micros"], part["event_id"], part["failed"], part["error"], strict=True):
                if failed:
                    failures[(int(t), int(i))] = text
                else:
                    resolved = int(t) if resolved is None else max(resolved, int(t))
        # the latest failures after the last resolution and the last gap longer than state is kept; only the last one's error is read
        kept = sorted(x for x in failures if resolved is None or x[0] > resolved)[-MOST:]
        gaps = [k for k in range(1, len(kept)) if kept[k][0] - kept[k - 1][0] > self.keep]
        kept = kept[gaps[-1] :] if gaps else kept
        error = failures[kept[-1]] if kept else None
        geometry = bool(kept) and "GEOMETRY_MISSING" in (error or "").upper()
        self.state.update((resolved, [t for t, _ in kept], [i for _, i in kept], error, geometry, newest))
        n = len(kept)
        due = NEVER if n >= MOST or geometry else kept[-1][0] + BACKOFF[n - 1] * HOUR if n else None
        status = "resolved" if not n else "manual" if due == NEVER else "waiting"
        self._timer(due if status == "waiting" else newest + self.keep)
        yield self._row(key, status, n, error, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        resolved, times, _, error, geometry, last = self.state.get()
        n = len(times or [])
        waiting = 0 < n < MOST and not geometry
        due = times[-1] + BACKOFF[n - 1] * HOUR if waiting else None
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if waiting and now >= due and now < max(due, last + self.keep):
            self.handle.registerTimer(max(due, last + self.keep) // 1000 + 1)
            yield self._row(key, "due", n, error, due)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


class SecondAuctions(StatefulProcessor):
    """Auctions of one property (case and register): the first listing stays, price and date are the latest one's.

    State: first and last listing by (time, id), of equal ones the one with the higher price, and their number.  A timer clears a property that had no auction for ``keep_days``.
    """

    def __init__(self, keep_days: int):
        self.keep = keep_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("property", "first_at long, first_id long, last_at long, last_id long, price decimal(14,2), n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.exists()
        first_at, first_id, last_at, last_id, price, n = self.state.get() if known else (None, None, None, None, None, 0)
        for part in rows:
            at, ids, prices = part["micros"].tolist(), part["listing_id"].tolist(), part["price_zl"].tolist()
            order = sorted(range(len(ids)), key=lambda k: (at[k], ids[k], prices[k] is not None, prices[k] or 0))
            low, high = order[0], order[-1]
            if first_at is None or (at[low], ids[low]) < (first_at, first_id):
                first_at, first_id = int(at[low]), int(ids[low])
            if last_at is None or (at[high], ids[high], prices[high] or 0) > (last_at, last_id, price or 0):
                last_at, last_id, price = int(at[high]), int(ids[high]), prices[high]
            n += len(ids)
        self.state.update((first_at, first_id, last_at, last_id, price, n))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((last_at + self.keep) // 1000 + 1)
        yield pd.DataFrame({"case_key": [key[0]], "listing_id": [first_id], "price_zl": [price], "latest": [last_at], "n_auctions": [n], "status": ["requeued" if n > 1 else "new"]}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def retry_queue(attempts: DataFrame, delay: str = "1 day", keep_days: int = 365) -> DataFrame:
    """Changes of the retry queue of a stream (listing_id, event_id, at, failed, error), and rows of listings that are due.

    Rows that come later than ``delay`` behind the newest one are left out, as in any stream with a watermark.  A null error
    is none; rows without a listing_id, an event_id or a time are left out; a repeated event_id at one time counts once.
    """
    rows = attempts.filter("listing_id IS NOT NULL AND at IS NOT NULL AND event_id IS NOT NULL").select("listing_id", "event_id", "at", F.unix_micros("at").alias("micros"), F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("error", F.lit("")).alias("error"))
    changes = rows.withWatermark("at", delay).groupBy("listing_id").transformWithStateInPandas(statefulProcessor=RetryQueue(keep_days), outputStructType=RETRY, outputMode="Update", timeMode="EventTime")
    return changes.select("listing_id", "status", "attempt_count", "last_error", F.timestamp_micros("due").alias("next_retry_at"))


def second_auctions(listings: DataFrame, delay: str = "36500 days", keep_days: int | None = None) -> DataFrame:
    """Changes of the properties of a stream (case_key, listing_id, created_at, price_zl).

    ``delay`` is how late a listing may come.  Rows without a key or a time are left out.  With ``keep_days`` a property's state ends by
    a timer; without, it is the streaming aggregation of first, last and number, whose state is the same and calls no Python for a key.
    """
    rows = listings.filter("case_key IS NOT NULL AND created_at IS NOT NULL AND listing_id IS NOT NULL").select("case_key", "listing_id", "created_at", F.unix_micros("created_at").alias("micros"), "price_zl")
    if keep_days is None:
        first, last = F.min(F.struct("micros", "listing_id")).alias("first"), F.max(F.struct("micros", "listing_id", "price_zl")).alias("last")
        found = rows.groupBy("case_key").agg(first, last, F.count(F.lit(1)).alias("n_auctions"))
        status = F.when(F.col("n_auctions") > 1, "requeued").otherwise("new").alias("status")
        return found.select("case_key", F.col("first.listing_id").alias("listing_id"), F.col("last.price_zl").alias("price_zl"), F.timestamp_micros("last.micros").alias("created_at"), "n_auctions", status)
    changes = rows.withWatermark("created_at", delay).groupBy("case_key").transformWithStateInPandas(statefulProcessor=SecondAuctions(keep_days), outputStructType=AUCTIONS, outputMode="Update", timeMode="EventTime")
    return changes.select("case_key", "listing_id", "price_zl", F.timestamp_micros("latest").alias("created_at"), "n_auctions", "status")


def write_log(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, to a log of changes: a folder for each micro-batch, which a repeated one overwrites."""
    changes.sparkSession.conf.set(*STORE)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(changes: DataFrame, path: str, key: str) -> DataFrame:
    """The newest row of each key of the log that ``changes`` were written to; a row of a later micro-batch is newer.

    A stream without any row has written no micro-batch, and its log has no rows.
    """
    spark, kind = changes.sparkSession, changes.schema
    try:
        log = spark.read.schema(kind.add("batch", "long")).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], changes.schema)
    names = [c for c in log.columns if c not in (key, "batch")]
    return log.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("x")).select(key, "x.*")
