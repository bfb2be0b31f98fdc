"""WKB, links, dates, reviews and readiness in the cases that the registered queries leave out."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.operators import backlog as ops
from landspark.sources import wkb

SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
HOLE = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]


def polygon(rings, order="<", code=3, extra=0, srid=None):
    out = struct.pack(order + "BI", order == "<", code) + (struct.pack(order + "I", srid) if srid else b"") + struct.pack(order + "I", len(rings))
    for ring in rings:
        out += struct.pack(order + "I", len(ring)) + b"".join(struct.pack(f"{order}{2 + extra}d", *p, *[7.0] * extra) for p in ring)
    return out


def several(parts, code=6, order="<"):
    return struct.pack(order + "BII", order == "<", code, len(parts)) + b"".join(parts)


WKB = {
    "plain": (polygon([SQUARE]), 100, 1),
    "hole": (polygon([SQUARE, HOLE]), 96, 1),
    "big endian": (polygon([SQUARE, HOLE], ">"), 96, 1),
    "srid": (polygon([SQUARE], code=3 | wkb.HAS_SRID, srid=2180), 100, 1),
    "z": (polygon([SQUARE], code=3 | wkb.HAS_Z, extra=1), 100, 1),
    "zm by thousands": (polygon([SQUARE], code=3003, extra=2), 100, 1),
    "multi": (several([polygon([SQUARE, HOLE]), polygon([[(x + 20, y) for x, y in SQUARE]], ">")]), 196, 2),
    "collection": (several([polygon([SQUARE])], 7), 100, 1),
    "reversed ring": (polygon([SQUARE[::-1]]), 100, 1),
}
BAD = {"point": struct.pack("<BIdd", 1, 1, 1.0, 2.0).hex(), "cut": polygon([SQUARE]).hex()[:40], "odd": "012", "letters": "xyz", "empty": "", "null": None, "no parts": several([]).hex()}


def test_wkb(spark):
    rows = [(k, v[0].hex(), "x") for k, v in WKB.items()] + [(k, v, "y") for k, v in BAD.items()]
    out = wkb.decode_wkb(spark.createDataFrame(rows, "k string, geom_wkb string, other string"))
    got = {r.k: (r.area, r.n, r.geom_error) for r in out.select("k", g.area(F.col("geom")).alias("area"), F.size("geom").alias("n"), "geom_error").collect()}
    assert {k: got[k] for k in WKB} == {k: (v[1], v[2], None) for k, v in WKB.items()}
    assert all(got[k][0] is None and got[k][2] for k in BAD)
    assert out.limit(0).count() == 0 and wkb.decode_wkb(spark.createDataFrame([], "geom_wkb string")).count() == 0


HREFS = {
    ("https://a.pl/x/y.html", '<a href="z.pdf">'): "https://a.pl/x/z.pdf",
    ("https://a.pl/x/y.html", "<a HREF='/z.pdf?a=1&amp;b=2'>"): "https://a.pl/z.pdf?a=1&b=2",
    ("https://a.pl/x/w/y.html?q=1", '<a href="../z/./u">'): "https://a.pl/x/z/u",
    ("https://a.pl", '<a href="z">'): "https://a.pl/z",
    ("https://a.pl/x", '<a href="http://b.pl/z">'): "http://b.pl/z",
    ("https://a.pl/x", '<a href="//b.pl/z">'): "https://b.pl/z",
    ("https://a.pl/x/y?b=1", '<a href="?c=2">'): "https://a.pl/x/y?c=2",
    ("https://a.pl/x/y", '<a href="..">'): "https://a.pl/",
    ("https://a.pl/x", "no link"): None,
    ("https://a.pl/x", None): None,
}


def test_links(spark):
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(HREFS)], "i int, base string, fragment string")
    got = {r.i: r.h for r in rows.select("i", ops.resolve_href(F.col("base"), F.col("fragment")).alias("h")).collect()}
    assert [got[i] for i in range(len(HREFS))] == list(HREFS.values())


def test_dates(spark):
    day = datetime.date(2026, 5, 4)
    want = {"2026-05-04": day, "2026/05/04": day, "04.05.2026": day, "2026-13-01": None, "May": None, "": None, None: None}
    got = {r.x: r.d for r in spark.createDataFrame([(x,) for x in want], "x string").select("x", ops.signal_date(F.col("x")).alias("d")).collect()}
    assert got == want


@pytest.mark.parametrize("known, status, advice, state", [
    (None, None, "wykazplanow", "ready"), ([], "live", "wykazplanow", "ready"), (["html_index"], "live", "studium_or_pog_geometry", "needs_geometry_source"),
    (["planning_zone_passthrough"], "live", "heuristics_tuning", "live"), (["planning_zone_passthrough", "html_index"], None, "mpzp_project_or_resolution", "partial"), ([], "upstream_broken", "manual_research", "upstream_broken"),
])
def test_advice(spark, known, status, advice, state):
    near = spark.createDataFrame([("1", 3)], "teryt_gmina string, parcels int")
    sources = spark.createDataFrame([("1", known)], "teryt_gmina string, known array<string>")
    row = ops.source_backlog(near, sources, spark.createDataFrame([("1", status, None)], "teryt_gmina string, html_status string, html_error string")).first()
    assert (row.next_best_source_type, row.operator_status) == (advice, state)


def test_triage(spark):
    rows = {(None, None, "Lasek"): "missing_parcel", ("1", 0.66, "Lasek"): "low_regex_confidence", ("1", 0.8, "Sąd Rejonowy"): "missing_locality", ("1", 0.8, "12345"): "missing_locality", ("1", 0.8, "Ab"): "missing_locality", ("1", 0.8, None): "missing_locality", ("1", 0.7, "Łąka"): None}
    got = spark.createDataFrame([(i, *k) for i, k in enumerate(rows)], "i int, number string, confidence double, locality string").select("i", ops.triage(F.col("number"), F.col("confidence"), F.col("locality")).alias("r")).collect()
    assert [r.r for r in sorted(got, key=lambda r: r.i)] == list(rows.values())


def test_province_backlog_has_all_columns(spark):
    gaps, future = spark.createDataFrame([("1", "a")], "teryt_gmina string, bucket string"), spark.createDataFrame([("2", 5)], "teryt_gmina string, parcel_count int")
    out = ops.province_backlog(gaps, future)
    assert tuple(out.columns) == ops.BACKLOG and {(r.backlog_family, r.teryt_gmina, r.bucket, r.parcel_count) for r in out.collect()} == {("coverage_gap", "1", "a", None), ("future_signal", "2", None, 5)}
