"""Steps that are made once a row, and tasks that get a bounded number of rows."""

from pyspark.sql import functions as F

from landspark import fixtures
from landspark.functions import text as t
from landspark.operators import reports
from landspark.operators import text as ops

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_price_is_parsed_once(spark):
    df = spark.createDataFrame([("1.234,56",)], "x string")
    text = plan(df.select(t.sane_price(t.parse_decimal(F.col("x"))).alias("v")))
    assert text.count("regexp_replace(") == 1, text
    assert plan(df.select(t.extract_price(F.col("x")).alias("v"))).count("translate(lower(") == 1


def test_registers_in_one_pass(spark):
    rows = [
        (1, "xWA1M/12345678/1 oraz WA1M-12345678-2"), (1, "WA1M 12345678 3, KR1K/87654321"), (2, "KR1K/87654321 i kr1k 87654321 4"), (3, "GD4K/11111111/1, GD4K/11111111/2, GD4K/11111111/1"),
        (4, "wa1m/12345678/x WA1M/12345678/1/KR1K/87654321"), (5, None),
    ]
    df = ops.extract_registers(spark.createDataFrame(rows, "i int, text string"), "i")
    assert "Union" not in plan(df)
    got = sorted((r.doc_id, r.normalized, r.source) for r in df.collect())
    strict, relaxed, partial = "free_text_regex", "relaxed_regex", "no_check_digit"
    assert got == [
        (1, "KR1K/87654321/?", partial), (1, "WA1M/12345678/1", strict), (2, "KR1K/87654321/4", relaxed), (3, "GD4K/11111111/1", strict), (3, "GD4K/11111111/2", strict), (4, "WA1M/12345678/1", relaxed),
    ]


def test_tasks_that_group_listings_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "GROUPED_ROWS", 1000, raising=False)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert fixtures.derived(spark, SF, "fx_listings").rdd.getNumPartitions() >= rows // 1000 > 4


def test_ids_of_a_sweep_are_not_broadcast(spark):
    queue = spark.range(0, 400, 1, 1).selectExpr("id AS listing_id", "1 AS attempt_count", "'x' AS last_error", "cast(null AS string) AS raw_obreb", "'1' AS raw_numer_dzialki")
    left, manual = reports.sweep_retry(queue, spark.range(0, 400, 2, 1).selectExpr("id AS listing_id"))
    assert sorted(r.listing_id for r in left.collect()) == list(range(1, 400, 2)) and not manual.count()
    assert "BroadcastHashJoin" not in left._jdf.queryExecution().executedPlan().toString()
