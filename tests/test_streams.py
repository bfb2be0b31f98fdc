"""Keyed streams equal a replay of all rows at once, however the rows fall into micro-batches, and go on after a restart."""

import os
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from landspark.operators.tables import BACKOFF
from landspark.streaming import jobs, stateful

START, NEVER = datetime(2026, 1, 1), datetime(9999, 12, 31)
ATTEMPTS = pa.schema([("listing_id", pa.int64()), ("event_id", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("failed", pa.bool_()), ("error", pa.string())])
LISTINGS = pa.schema([("case_key", pa.string()), ("listing_id", pa.int64()), ("created_at", pa.timestamp("us", "UTC")), ("price_zl", pa.decimal128(14, 2))])


def put(folder, k, rows, schema):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/part-{k:03d}.parquet"
    pq.write_table(pa.Table.from_pylist(rows, schema), path)
    os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def run(spark, folder, out, make, key):
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    changes = make(stream)
    stateful.write_log(changes, f"file://{out}/log", f"file://{out}/checkpoint").awaitTermination()
    return {r[key]: r for r in stateful.read_log(changes, f"file://{out}/log", key).collect()}


def attempts(seed, n=260):
    rng = random.Random(seed)
    rows = [
        {"listing_id": rng.choice([*range(12), None] if k % 40 == 0 else range(12)), "event_id": k, "at": START + timedelta(minutes=37 * k + rng.randrange(30)), "failed": rng.random() < 0.75, "error": rng.choice(["no parcel", "geometry_missing: empty", None, "x", "y", "z"])}
        for k in range(n)
    ]
    return rows + [{"listing_id": 3, "event_id": 9000, "at": None, "failed": True, "error": "x"}]


def replay(rows, delay):
    rows = [r for r in rows if r["listing_id"] is not None and r["at"] is not None]
    mark, out = max(r["at"] for r in rows) - delay, {}
    for i in {r["listing_id"] for r in rows}:
        mine = sorted((r["at"], r["event_id"], r["failed"], r["error"]) for r in rows if r["listing_id"] == i)
        solved = max((r[0] for r in mine if not r[2]), default=None)
        failures = [r for r in mine if r[2] and (solved is None or r[0] > solved)]
        n, error = min(len(failures), 5), failures[-1][3] or "" if failures else None
        due = None if not n else NEVER if n == 5 or "GEOMETRY_MISSING" in error.upper() else failures[-1][0] + timedelta(hours=BACKOFF[n - 1])
        out[i] = ("resolved" if not n else "manual" if due == NEVER else "due" if due < mark else "waiting", n, error, due)
    return out


def queue(rows):
    return {i: (r.status, r.attempt_count, r.last_error, r.next_retry_at) for i, r in rows.items()}


@pytest.mark.parametrize("files", [1, 7])
def test_retry_queue_in_any_split(spark, tmp_path, files):
    rows, delay = attempts(files), timedelta(days=2)
    rng = random.Random(1)
    # neighbours are shuffled, so that rows come late, within the delay
    order = sorted(range(len(rows)), key=lambda k: k + rng.randrange(25))
    for k in range(files):
        put(tmp_path / "in", k, [rows[j] for j in order[k * len(rows) // files : (k + 1) * len(rows) // files]], ATTEMPTS)
    got = run(spark, tmp_path / "in", tmp_path, lambda s: stateful.retry_queue(s, "2 days"), "listing_id")
    wanted = replay(rows, delay)
    assert queue(got) == wanted
    assert {x[0] for x in wanted.values()} >= {"resolved", "manual"}


def test_retry_queue_after_a_restart(spark, tmp_path):
    rows = attempts(5)
    make = lambda s: stateful.retry_queue(s, "2 days")
    put(tmp_path / "in", 0, rows[:130], ATTEMPTS)
    before = run(spark, tmp_path / "in", tmp_path, make, "listing_id")
    assert queue(before) == replay(rows[:130], timedelta(days=2))
    put(tmp_path / "in", 1, rows[130:], ATTEMPTS)
    assert queue(run(spark, tmp_path / "in", tmp_path, make, "listing_id")) == replay(rows, timedelta(days=2))


def test_state_expires(spark, tmp_path):
    """A listing without a row for longer than its state is kept begins again; one within that time doesn't."""
    row = lambda i, e, days: {"listing_id": i, "event_id": e, "at": START + timedelta(days=days), "failed": True, "error": "x"}
    put(tmp_path / "in", 0, [row(1, 1, 0), row(2, 2, 0), row(2, 3, 9)], ATTEMPTS)
    put(tmp_path / "in", 1, [row(3, 4, 15)], ATTEMPTS)
    put(tmp_path / "in", 2, [row(1, 5, 16), row(2, 6, 16)], ATTEMPTS)
    got = run(spark, tmp_path / "in", tmp_path, lambda s: stateful.retry_queue(s, "1 day", keep_days=10), "listing_id")
    assert (got[1].attempt_count, got[2].attempt_count) == (1, 3)


@pytest.mark.parametrize("files", [1, 5])
def test_second_auctions_in_any_split(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [{"case_key": rng.choice(["a", "b", "c", "d", None]), "listing_id": k, "created_at": START + timedelta(hours=rng.randrange(40)), "price_zl": Decimal(rng.randrange(10**6)) / 100} for k in range(60)]
    for k in range(files):
        put(tmp_path / "in", k, rows[k * 60 // files : (k + 1) * 60 // files], LISTINGS)
    got = run(spark, tmp_path / "in", tmp_path, stateful.second_auctions, "case_key")
    wanted = {}
    for key in {r["case_key"] for r in rows} - {None}:
        mine = sorted((r["created_at"], r["listing_id"], r["price_zl"]) for r in rows if r["case_key"] == key)
        wanted[key] = (mine[0][1], mine[-1][2], mine[-1][0], len(mine), "requeued" if len(mine) > 1 else "new")
    assert {k: (r.listing_id, r.price_zl, r.created_at, r.n_auctions, r.status) for k, r in got.items()} == wanted


def test_registered_once_for_ever(spark, tmp_path):
    for k, users in enumerate(([1, 2, 2], [2, 3], [1, 3, 4])):
        put(tmp_path / "in", k, [{"case_key": str(u), "listing_id": 10 * k + u, "created_at": START, "price_zl": Decimal(1)} for u in users], LISTINGS)
    got = run(spark, tmp_path / "in", tmp_path, lambda s: jobs.register_exactly(s.select("case_key", "listing_id"), "case_key"), "case_key")
    assert {k: r.listing_id for k, r in got.items()} == {"1": 1, "2": 2, "3": 13, "4": 24}


def test_alerts(spark, tmp_path):
    put(tmp_path / "in", 0, [{"case_key": "MN", "listing_id": i, "created_at": START + timedelta(days=i), "price_zl": Decimal(i)} for i in range(6)], LISTINGS)

    def make(stream):
        leads = stream.select(F.col("listing_id").alias("lead_id"), (F.col("price_zl") / 5).alias("confidence_score"), F.col("price_zl").alias("max_coverage_pct"), F.col("case_key").alias("dominant_przeznaczenie"), "created_at")
        return jobs.stream_watchlist(leads, F.to_timestamp(F.lit("2026-01-04 12:00:00")), min_confidence_pct=30, min_coverage_pct=2, designation="mn").select("lead_id", "created_at")

    assert set(run(spark, tmp_path / "in", tmp_path, make, "lead_id")) == {4, 5}


def test_empty_streams(spark, tmp_path):
    put(tmp_path / "a", 0, [], ATTEMPTS)
    put(tmp_path / "b", 0, [], LISTINGS)
    assert run(spark, tmp_path / "a", tmp_path / "x", stateful.retry_queue, "listing_id") == {}
    assert run(spark, tmp_path / "b", tmp_path / "y", stateful.second_auctions, "case_key") == {}


def test_second_auctions_call_no_python_for_a_key(spark, tmp_path):
    put(tmp_path / "in", 0, [{"case_key": "a", "listing_id": 1, "created_at": START, "price_zl": None}, {"case_key": "a", "listing_id": 1, "created_at": START, "price_zl": Decimal(-2)}], LISTINGS)
    got = run(spark, tmp_path / "in", tmp_path, stateful.second_auctions, "case_key")
    assert (got["a"].price_zl, got["a"].n_auctions) == (Decimal(-2), 2)
    made = stateful.second_auctions(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
    assert "TransformWithState" not in made._jdf.queryExecution().analyzed().toString()
