"""Faults of polygons by cases, and self-crossing against a test of all pairs of edges."""

import math
import random

from landspark.operators import polygons as ops

GEOM = "id long, geom array<array<array<struct<x: double, y: double>>>>"


def side(p, q, r):
    d = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (d > 0) - (d < 0)


def crosses(ring):
    """All pairs of edges of a ring without its closing vertex."""
    n = len(ring)
    for i in range(n):
        for j in range(i + 1, n):
            a, b, c, d = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
            if j == i + 1 or (i == 0 and j == n - 1):
                u, v, w = (a, b, d) if j == i + 1 else (b, a, c)
                if side(u, v, w) == 0 and (u[0] - v[0]) * (w[0] - v[0]) + (u[1] - v[1]) * (w[1] - v[1]) > 0:
                    return True
            elif side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0:
                if all(max(min(a[k], b[k]), min(c[k], d[k])) <= min(max(a[k], b[k]), max(c[k], d[k])) for k in (0, 1)):
                    return True
    return False


def test_crossing_by_all_pairs(spark):
    rng = random.Random(3)
    rings = [[(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(rng.randrange(3, 7))] for _ in range(300)]
    rings += [[(math.cos(2 * math.pi * k / n) * r(k), math.sin(2 * math.pi * k / n) * r(k)) for k in range(n)] for n in (3, 50, 400) for r in (lambda k: 10.0, lambda k: 10.0 + k % 3)]
    rings += [[(0.0, 0.0), (1000.0, 0.0), (1000.0, 1.0)] + [(1000.0 - k, 1.0 + k % 2) for k in range(1, 900)] + [(0.0, 5.0)]]
    rings = [[p for k, p in enumerate(r) if k == 0 or p != r[k - 1]] for r in rings]
    rings = [r[:-1] if r[-1] == r[0] else r for r in rings]
    rings = [r for r in rings if len(r) > 2]
    rows = spark.createDataFrame([(k, [[r + r[:1]]]) for k, r in enumerate(rings)], GEOM).repartition(4)
    assert {r.id for r in ops.crossing_rings(rows, "id").collect()} == {k for k, r in enumerate(rings) if crosses(r)}


def test_faults_and_quarantine(spark):
    square = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)]
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
    cases = {
        1: ([[square, hole]], None), 2: ([[square[:-1]]], ["open_ring"]), 3: ([[square, [(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]], ["short_ring"]), 4: ([[[(0.0, 0.0), (0.0, 9.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)]]], ["self_crossing", "zero_area"]),
        5: ([], ["no_ring"]), 6: (None, ["no_ring"]), 7: ([[square], []], ["no_ring"]), 8: ([[square[:2] + square[1:2] + square[2:]]], None), 9: ([[[]]], ["no_ring"]), 10: ([[square], [hole[:-1]]], ["open_ring"]),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], GEOM)
    assert {r.id: r.reasons for r in ops.polygon_faults(rows, "id").collect()} == {k: v[1] for k, v in cases.items() if v[1]}
    good, bad = ops.quarantine(rows, "id")
    assert sorted(r.id for r in good.collect()) == [1, 8] and "reasons" in bad.columns and bad.count() == 8
    assert ops.polygon_faults(rows.limit(0), "id").count() == 0
