"""Re-parse decisions by cases, resets that are repeated, grids and neighbourhoods against plain Python, empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from landspark.operators import grids, places, repair

LISTINGS = "listing_id long, raw_numer string, raw_obreb string, raw_gmina string, raw_text string, is_processed boolean, number string"
#: Stored number, precinct, commune and text: actions and new values (None: no row).
CASES = [
    ("32", "Zakopane", None, "działki nr 256/11, jedn. ewid. Podgórze, obręb 94", ("replace", "256/11", "replace", "Podgórze")),
    (None, None, None, "działka nr 492/2 położona w Lasku", ("replace", "492/2", "replace", "Lasku")),
    ("492/2", "Lasku", None, "działka nr 492/2 położona w Lasku", None),
    ("44", None, None, "nieruchomość, 44-105 Gliwice, poczta Gliwice", ("clear", None, "replace", "Gliwice")),
    ("44", "Gliwice", None, "adres 44-105 Gliwice, poczta Gliwice, ewidencyjna pod 44", None),
    ("abc", "Gliwice", None, "dom w mieście", ("clear", None, "keep", "Gliwice")),
    ("7", "numerze KW", "Knurów", "działka nr 1234 położona w Knurowi", ("replace", "1234", "replace", "Knurów")),
    ("123/4", "Knurów", None, "działka nr 123/4. Adres nieruchomości 33-250 Kłyż, poczta Otfinów", ("keep", "123/4", "replace", "Kłyż")),
    ("123/4", "Knurów", None, "działka nr 123/4 położona w Knurów. Adres nieruchomości 33-250 Kłyż, poczta Otfinów", None),
    ("5", "Las", None, "   ", None),
    ("5", "Las", None, None, None),
    ("5", "Las", None, "", None),
]


def test_reparse(spark):
    rows = spark.createDataFrame([(i, *c[:4], True, "x") for i, c in enumerate(CASES)], LISTINGS)
    docs = rows.select("listing_id", F.col("raw_text").alias("text"))
    found = places.extract_parcels(docs, "listing_id"), places.extract_localities(docs, "listing_id"), places.extract_precinct(docs, "listing_id")
    decisions = repair.reparse(rows, *found)
    got = {r.listing_id: (r.parcel_action, r.new_numer, r.precinct_action, r.new_obreb) for r in decisions.collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: c[4] for i, c in enumerate(CASES)}
    queue = spark.createDataFrame([(0, "e"), (2, "e")], "listing_id long, last_error string")
    after, left = repair.apply_reparse(rows, queue, decisions)
    assert [r.listing_id for r in left.collect()] == [2]
    state = {r.listing_id: (r.raw_numer, r.is_processed) for r in after.collect()}
    assert state[0] == ("256/11", False) and state[2] == ("492/2", True) and state[3] == (None, False) and after.columns == rows.columns


def tables(spark, empty=False):
    q = "listing_id long, last_error string, attempt_count int, raw_obreb string, raw_numer_dzialki string, next_retry_at timestamp"
    rows = {
        "listings": ([(1, "12", True), (2, "12", False), (3, "12", True), (4, "18", False), (5, None, True), (6, "12", True)], "listing_id long, province string, is_processed boolean"),
        "queue": ([(1, "x", 1, "o", "1", None), (3, "x", 5, "o", "1", None), (5, "x", 1, "o", "1", None), (6, "x", 1, "o", "1", None)], q),
        "links": ([(2, 20), (2, 21), (4, 21), (6, 60)], "listing_id long, parcel_id long"),
        "leads": ([(1, 20), (2, 21), (3, 60), (4, 99)], "lead_id long, parcel_id long"),
        "deltas": ([(20,), (60,)], "parcel_id long"),
        "parcels": ([(20,), (21,), (60,), (99,)], "parcel_id long"),
        "backlog": ([(3, "old"), (9, "old")], "listing_id long, last_error string"),
    }
    return {k: spark.createDataFrame([] if empty else v, s) for k, (v, s) in rows.items()}


def state(t):
    return {k: sorted(map(str, df.collect())) for k, df in t.items()}


def test_reset_of_a_province(spark):
    now = F.to_timestamp(F.lit("2026-01-01"))
    after, report = repair.reset_scope(tables(spark), now, province="12")
    ids = lambda name, key: sorted(r[key] for r in after[name].collect())
    # 6 is linked and leaves the queue, 3 goes to the backlog; targets are 1 (queued) and 2 (open)
    assert ids("queue", "listing_id") == [1, 5] and ids("backlog", "listing_id") == [3, 9]
    assert {r.listing_id: r.is_processed for r in after["listings"].collect()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: True}
    assert {r.listing_id for r in after["queue"].filter("next_retry_at IS NOT NULL").collect()} == {1}
    assert sorted((r.listing_id, r.parcel_id) for r in after["links"].collect()) == [(4, 21), (6, 60)]
    assert ids("leads", "lead_id") == [3, 4] and ids("deltas", "parcel_id") == [60] and ids("parcels", "parcel_id") == [21, 60, 99]
    counts = {r.table: (r.n_before, r.n_after, r.n_changed) for r in report.collect()}
    assert counts == {"listings": (6, 6, 2), "queue": (4, 2, 1), "links": (4, 2, 2), "leads": (4, 2, 2), "deltas": (2, 1, 1), "parcels": (4, 3, 1), "backlog": (2, 2, 0)}
    again, _ = repair.reset_scope(after, now, province="12")
    assert state(again) == state(after)


def test_reset_by_ids_and_of_everything(spark):
    now = F.to_timestamp(F.lit("2026-01-01"))
    after, _ = repair.reset_scope(tables(spark), now, ids=spark.createDataFrame([(6,), (6,), (77,)], "listing_id long"))
    assert sorted(r.parcel_id for r in after["parcels"].collect()) == [20, 21, 99] and sorted(r.lead_id for r in after["leads"].collect()) == [1, 2, 4]
    assert sorted(r.listing_id for r in after["queue"].collect()) == [1, 3, 5]
    t = tables(spark)
    t["queue"] = t["queue"].limit(0)
    after, _ = repair.reset_scope(t, now)
    assert after["leads"].count() == after["deltas"].count() == 0 and after["parcels"].count() == 4
    after, report = repair.reset_scope(tables(spark, empty=True), now, province="12")
    assert all(df.count() == 0 for df in after.values()) and {r.n_changed for r in report.collect()} == {0}


SQUARE = [[[(0.0, 0.0), (0.0, 30.0), (30.0, 30.0), (30.0, 0.0)], [(9.0, 9.0), (21.0, 9.0), (21.0, 21.0), (9.0, 21.0)]]]


def test_grid(spark):
    shape = "parcel_id long, geom array<array<array<struct<x:double,y:double>>>>"
    cells = grids.grid_cells(spark.createDataFrame([(1, SQUARE), (2, []), (3, None)], shape), 1)
    # three cells a side at least; the one in the hole is none
    assert sorted((r.parcel_id, r.ix, r.iy) for r in cells.collect()) == [(1, i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    hits = "parcel_id long, ix int, iy int, designation string, description string, plan_name string, resolution string"
    found = grids.sampled_zones(cells, spark.createDataFrame([(1, 0, 0, "MN", None, "p", None), (1, 0, 1, "MN", "", "p", None), (1, 1, 1, "MN", "", "p", None), (1, 2, 2, "U", "d", "p", "r"), (1, 2, 1, None, "d", "p", "r")], hits)).collect()
    assert sorted((r.designation, r.n_cells, r.area, [(c.ix, c.iy) for c in r.cells]) for r in found) == [("MN", 2, pytest.approx(200), [(0, 0), (0, 1)]), ("U", 1, pytest.approx(100), [(2, 2)])]


def test_neighbourhood(spark):
    import random

    rng, side, r = random.Random(1), 9, 2
    colour = {(x, y): rng.choice([(255, 255, 255), (1, 2, 3), (9, 9, 9), (255, 255, 255)]) for x in range(side) for y in range(side)}
    for x in range(5):
        for y in range(5):
            colour[(x, y)] = (255, 255, 255)
    pixels = spark.createDataFrame([(7, x, y, *c) for (x, y), c in colour.items()], "image_id int, px int, py int, r int, g int, b int")
    points = [(k, 7, k % side, k // side) for k in range(side * side)] + [(500, 8, 1, 1), (501, 7, None, 1)]
    size = spark.createDataFrame([(7, side, side)], "image_id int, width int, height int")
    white = F.col("r") == 255
    got = {x.id: (x.r, x.g, x.b, x.n) for x in grids.neighbourhood_mode(spark.createDataFrame(points, "id long, image_id int, px int, py int"), pixels, size, white, r).collect()}
    for k, _, cx, cy in points[: side * side]:
        seen = Counter(colour[(max(0, min(side - 1, cx + dx)), max(0, min(side - 1, cy + dy)))] for dx in range(-r, r + 1) for dy in range(-r, r + 1))
        best = next((c for c, _ in seen.most_common() if c[0] != 255), seen.most_common()[0][0])
        assert got[k] == (*best, seen[best])
    assert len(got) == side * side
