"""Every land query against its DuckDB SQL on the smallest tables, and those without SQL against plain Python."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from landspark import queries as land
from landspark.fixtures import SQL, derived

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(land.ORACLE))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(land.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_derived_tables(spark, duck):
    for name, text in SQL.items():
        df = derived(spark, SF, name)
        want = duck.execute(f"SELECT count(*) FROM ({text})").fetchall()[0][0]
        assert df.count() == want > 0, name


def segments(ring):
    return list(zip(ring, ring[1:] + ring[:1], strict=True))


def point_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def inside(p, ring):
    hit = False
    for a, b in segments(ring):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            hit = not hit
    return hit


def distance(one, two):
    if inside(one[0], two) or inside(two[0], one):
        return 0.0
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    best = math.inf
    for a, b in segments(one):
        for c, d in segments(two):
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return 0.0
            best = min(best, point_segment(a, c, d), point_segment(b, c, d), point_segment(c, a, b), point_segment(d, a, b))
    return best


def rings(df, key):
    return {r[key]: [(v.x, v.y) for v in r.geom[0][0]] for r in df.select(key, "geom").collect()}


def test_distances(spark):
    parcels, zones = rings(derived(spark, SF, "fx_parcels"), "parcel_id"), rings(derived(spark, SF, "fx_zones"), "zone_id")
    want = {(i, j): round(d, 4) for i, a in parcels.items() for j, b in zones.items() if (d := distance(a, b)) <= 30}
    got = {(r.left_id, r.right_id): r.distance_m for r in entry.queries()["c2_dwithin_join"](spark, SF).collect()}
    assert got == pytest.approx(want) and len(want) > 50


def test_nearest(spark):
    from landspark.operators import spatial

    parcels, zones = derived(spark, SF, "fx_parcels").filter("parcel_id % 20 = 0"), derived(spark, SF, "fx_zones").filter("zone_id % 5 = 0")
    one, two = rings(parcels, "parcel_id"), rings(zones, "zone_id")
    want = {i: min(distance(a, b) for b in two.values()) for i, a in one.items()}
    got = {r.left_id: r.distance_m for r in spatial.nearest_distance(parcels, zones, "parcel_id", "zone_id", 2000.0).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert spatial.nearest_distance(parcels, zones.limit(0), "parcel_id", "zone_id").count() == 0


def test_display_points_lie_inside(spark):
    got = entry.queries()["b_geom_hash"](spark, SF).collect()
    assert got and all(r.inside for r in got)


def test_reprojection(spark):
    from pyspark.sql import functions as F

    from landspark.functions import geometry as g

    got = entry.queries()["b_reproject"](spark, SF).collect()
    assert all(r.error_m == 0 and 14 < r.lon < 25 and 49 < r.lat < 55 for r in got)
    # on the central meridian the easting is the false one, and the northing grows with the scale of the meridian's arc
    r = spark.range(1).select(g.to_2180(F.lit(19.0), F.lit(52.0)).alias("p")).first().p
    assert r.x == pytest.approx(500000, abs=1e-6) and r.y == pytest.approx(459309.45, abs=0.5)
