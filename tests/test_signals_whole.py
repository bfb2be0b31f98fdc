"""Signals of whole communes reach every parcel of the commune: the registered queries against plain Python."""

from collections import defaultdict

import pytest

import __spark_entry__ as entry
from landspark.fixtures import derived
from landspark.functions import planning as p
from landspark.operators import signals as ops

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def attached(spark):
    """Every parcel's signals, each pair written out."""
    own, level = defaultdict(list), defaultdict(list)
    for r in ops.weighed(derived(spark, SF, "fx_signals")).collect():
        code = p.COVERAGE_ALIAS.get(r.teryt_gmina, r.teryt_gmina)
        (level[code] if r.parcel_id is None else own[r.parcel_id, code]).append(r)
    found = {}
    for r in derived(spark, SF, "fx_parcels").select("parcel_id", "teryt_gmina").collect():
        code = p.COVERAGE_ALIAS.get(r.teryt_gmina, r.teryt_gmina)
        if rows := own[r.parcel_id, code] + level[code]:
            found[r.parcel_id] = rows
    return found


def test_attach(spark, attached):
    got = {r.parcel_id: (r.n, r.s) for r in entry.queries()["c10_attach_signals"](spark, SF).collect()}
    assert got == {k: (len(x), sum(r.signal_id for r in x)) for k, x in attached.items()} and len(got) > 100


def test_score(spark, attached):
    def score(x):
        up = [r for r in x if r.weight > 0]
        kinds = {r.signal_kind for r in up}
        top = min(up, key=lambda r: (-r.weight, r.signal_id)).label if up else None
        negative = any(r.weight < 0 and r.designation_normalized in p.HARD_NEGATIVE for r in x)
        return sum(r.weight for r in x), len(up), bool(kinds & {"pog_zone", "pog_ouz", "studium_zone"}), bool(kinds & {"planning_resolution", "mpzp_project"}), negative, top

    got = {r.parcel_id: tuple(r)[1:] for r in entry.queries()["d15_score_signals"](spark, SF).select("parcel_id", "signal_score", "positive_signals", "has_formal_signal", "has_supporting_formal_signal", "hard_negative", "dominant_signal").collect()}
    assert got == {k: score(x) for k, x in attached.items()}


def corroborated(attached):
    want = {}
    for k, x in attached.items():
        by = defaultdict(set)
        for r in x:
            if r.signal_kind in ("planning_resolution", "mpzp_project") and r.designation_normalized in p.POSITIVE and r.weight > 0:
                by[r.designation_normalized].add(r.source_url or r.plan_name or str(r.signal_id))
        n, c = min(((-len(s), d) for d, s in by.items()), default=(0, ""))
        family = len(set().union(*by.values()))
        if family >= 3:
            want[k] = (c, -n) if -n >= 3 else ("urbanizable", family)
    return want


def test_corroborate(spark, attached):
    got = {r.parcel_id: (r.designation, r.n_sources) for r in entry.queries()["d16_corroborate"](spark, SF).collect()}
    assert got == corroborated(attached) and len(got) > 100


def test_own_and_communal_sources_count_once(spark):
    parcels = spark.createDataFrame([(1, "1261029"), (2, "1261011"), (3, "1801011"), (4, "1801012")], "parcel_id long, teryt_gmina string")
    a, b = ("planning_resolution", "formal_binding", "residential"), ("mpzp_project", "formal_binding", "service")
    rows = [
        (1, "1261011", None, *a, "u", None), (2, "1261011", None, *a, "v", None), (3, "1261039", 1, *a, "u", None), (4, "1261011", 2, *a, "", "w"),
        (5, "1801011", 3, *a, "u", None), (6, "1801011", 3, *b, "v", None), (7, "1801011", None, *b, None, None), (8, "1801012", None, *b, "u", None),
    ]
    signals = spark.createDataFrame(rows, "signal_id long, teryt_gmina string, parcel_id long, signal_kind string, signal_status string, designation_normalized string, source_url string, plan_name string")
    assert {r.parcel_id: (r.designation, r.n_sources) for r in ops.corroborate(parcels, signals).collect()} == {2: ("residential", 3), 3: ("urbanizable", 3)}
    assert {r.parcel_id: r.n for r in ops.count_signals(parcels, signals).collect()} == {1: 3, 2: 3, 3: 3, 4: 1}


def test_future_takes_them(spark, attached):
    """No parcel's future score is below its capped signals with their bonus."""
    bonus = corroborated(attached)
    got = {r.parcel_id: r.future_signal_score for r in entry.queries()["k2_run_future"](spark, SF).collect()}
    least = {k: min(100, max(0, sum(r.weight for r in x) + 10 * (k in bonus))) for k, x in attached.items()}
    assert all(got[k] >= v for k, v in least.items() if k in got) and sum(v > 0 for v in least.values()) > 100
