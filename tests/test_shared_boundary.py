"""Shared boundaries of all parcels with all zones, against brute force."""

import math

import pytest

import __spark_entry__ as entry
from landspark.fixtures import derived
from test_land_queries import SF, distance, rings, segments


def box(ring):
    xs, ys = zip(*ring, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def common(one, two):
    """Metres of the edges of ``one`` that lie on edges of ``two``."""
    total = 0.0
    for a, b in segments(one):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = math.hypot(dx, dy)
        for c, d in segments(two):
            if all(abs(dx * (q[1] - a[1]) - dy * (q[0] - a[0])) / n < 1e-7 for q in (c, d)):
                s, t = sorted(((q[0] - a[0]) * dx + (q[1] - a[1]) * dy) / n for q in (c, d))
                total += max(0.0, min(n, t) - max(0.0, s))
    return total


def test_every_parcel_and_zone(spark):
    parcels = rings(derived(spark, SF, "fx_parcels"), "parcel_id")
    zones = [(box(x), x) for name in ("fx_zones", "fx_zones_adjacent") for x in rings(derived(spark, SF, name), "zone_id").values()]
    got = {r.parcel_id: r for r in entry.queries()["c4_shared_boundary"](spark, SF).collect()}
    assert set(got) == set(parcels)
    several = 0
    for i, ring in parcels.items():
        p = box(ring)
        near = [x for b, x in zones if p[0] - 5 <= b[2] and b[0] - 5 <= p[2] and p[1] - 5 <= b[3] and b[1] - 5 <= p[3] and distance(ring, x) <= 5]
        metres, around = [common(ring, x) for x in near], sum(math.dist(a, b) for a, b in segments(ring))
        several += len(near) > 1
        assert got[i].own_shared_m == pytest.approx(sum(metres), abs=0.011), i
        assert got[i].own_pct == (pytest.approx(100 * max(metres) / around, abs=0.011) if near else None), i
    assert several
