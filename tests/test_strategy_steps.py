"""Steps of the resolution strategies: texts are cut once, and rows without a key are in no join by it."""

from pyspark.sql import functions as F

from landspark.functions.text import nominative
from landspark.operators import strategies as ops

LISTING = "listing_id long, raw_obreb string, raw_woj string, raw_kw string, area_m2 decimal(12,2)"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cut_into_words_once(spark):
    row = spark.range(1).selectExpr("concat('Stary Port ', id) AS t")
    runs = row.select(ops.runs_of(ops.words_of(F.col("t")), 3).alias("r"))
    assert runs.first().r == ["stary", "port", "0", "stary port", "port 0", "stary port 0"]
    assert optimized(runs).count("split(") == 1
    assert optimized(row.select(nominative(F.col("t")).alias("n"))).count("translate(") == 1


def test_listings_without_a_register_are_in_no_join_by_it(spark, monkeypatch):
    monkeypatch.setattr(ops, "small", lambda df: df)  # as with very many overrides
    listings = spark.createDataFrame([(1, "Lipa", None, None, None), (2, "Lipa", None, "kw 7", None), (3, "Lipa", None, "KW9", None)], LISTING)
    notices = spark.createDataFrame([(1, ["5"], None), (3, ["6"], None)], "listing_id long, numbers array<string>, text string")
    overrides = spark.createDataFrame([("KW7", ["8"], "Sosna")], "kw string, numbers array<string>, obreb string")
    rows = ops._hints(listings, notices, overrides)
    assert sorted((r.listing_id, r.numbers, r._obreb) for r in rows.collect()) == [(1, ["5"], None), (2, ["8"], "Sosna"), (3, ["6"], None)]
    joins = [line for line in optimized(rows).splitlines() if "Join LeftOuter" in line]
    assert joins and not any("_kw" in line for line in joins)
