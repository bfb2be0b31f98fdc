"""The registered spatial queries against brute force over all parcels and zones."""

import math

import pytest

import __spark_entry__ as entry
from landspark.fixtures import derived
from landspark.functions import planning as p
from test_land_queries import SF, distance, rings


def box(ring):
    xs, ys = zip(*ring, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def apart(a, b):
    """Distance of two boxes."""
    return math.hypot(max(a[0] - b[2], b[0] - a[2], 0), max(a[1] - b[3], b[1] - a[3], 0))


def test_nearest_of_all_parcels(spark):
    zones = derived(spark, SF, "fx_zones")
    parcels = rings(derived(spark, SF, "fx_parcels"), "parcel_id")
    got = {r.left_id: r for r in entry.queries()["c3_nearest_distance"](spark, SF).collect()}
    assert set(got) == set(parcels)
    for name, test in (("distance_m", p.is_buildable), ("distance_to_mixed_service_zone_m", p.is_mixed), ("distance_to_meaningful_road_m", p.is_road)):
        targets = [(box(x), x) for x in rings(zones.filter(test(zones.symbol)), "zone_id").values()]
        far = 0
        for i, ring in parcels.items():
            own, best = box(ring), math.inf
            for d, other in sorted(((apart(own, b), x) for b, x in targets), key=lambda t: t[0]):
                if d >= best:
                    break
                best = min(best, distance(ring, other))
            assert got[i][name] == pytest.approx(best, abs=1e-4), (i, name)
            far += best > 200
        assert far > 100
