"""No row holds a share of a table that grows with it."""

import __spark_entry__ as entry
from landspark.fixtures import derived
from landspark.operators import reports
from landspark.sources import geojson

SF = "/root/testdata/sf0.001"


def test_bodies_are_short(spark, monkeypatch):
    seen, ingest = [], geojson.ingest_cadastre
    monkeypatch.setattr(geojson, "ingest_cadastre", lambda bodies: seen.extend(bodies.collect()) or ingest(bodies))
    entry.queries()["a7_ingest_cadastre"](spark, SF).collect()
    assert max(r.body.count("\n") for r in seen) <= 100
    assert sum(r.body.count("\n") for r in seen) == derived(spark, SF, "fx_parcels").count()


def test_parts_are_bounded_and_whole(spark):
    parcels = derived(spark, SF, "fx_parcels").selectExpr("parcel_id", "'x' AS k", "geom")
    got = reports.collect_polygons(parcels, ["k"], "parcel_id", 100).selectExpr("n_parts", "size(geom) AS n").collect()
    assert sum(r.n for r in got) == parcels.count() and all(r.n == r.n_parts < 200 for r in got) and len(got) > 5


def test_a_province_is_looked_for_once(spark):
    from pyspark.sql import functions as F

    from landspark.functions import text as t
    from landspark.operators import text as ops

    rows = spark.createDataFrame([(1, "woj. śląskie")], "id long, text string").select("id", t.extract_location(F.col("text"))["province"].alias("province"))
    plan = ops.filter_province(rows, ["śląskie"]).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("w[oó]j[eę]w[oó]d") == 1 or plan.count("regexp_extract") == 2
