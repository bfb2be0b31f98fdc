"""Signals of planning pages: each rule by cases, precedence, snippets, and a plain search for the phrases."""

import re

import pytest

from landspark.operators import signal_pages as ops

SCHEMA = "source_id long, teryt_gmina string, source_url string, source_type string, confidence double, body string"
STUDY = "studium uwarunkowań i kierunków zagospodarowania przestrzennego"
PLAN = "miejscowego planu zagospodarowania przestrzennego"
LONG = "Wstęp o niczym. " * 30
#: Page: (type, form, kind, status, designation, class, plan, part of the description), or none.
CASES = [
    ("<h1>Plan ogólny gminy</h1><p>Obecnie trwa sporządzenie projektu planu.</p><p>Rada podjęła uchwałę w sprawie przystąpienia do sporządzenia planu ogólnego miasta.</p>", "html_index", "phrase", "planning_resolution", ops.PREPARATORY, "POG", "unknown", "POG 1", "przystąpienia do sporządzenia"),
    ("<h1>WAŻNE! Do piątku można składać WNIOSKI DO PLANU OGÓLNEGO</h1>", "html_index", "phrase", "planning_resolution", ops.PREPARATORY, "POG", "unknown", "POG 1", "WNIOSKI"),
    (f"<h1>Obowiązujące {STUDY} gminy Lipa</h1><p>System obejmuje plany.</p>", "html_index", "study", "planning_resolution", ops.DIRECTIONAL, "SUiKZP", "unknown", "SUiKZP 1", "gminy Lipa"),
    ("<p>Etap opiniowania i uzgadniania. Opiniowanie z Gminną Komisją Urbanistyczno-Architektoniczną.</p>", "html_index", "phrase", "planning_resolution", ops.PREPARATORY, "POG", "unknown", "POG 1", "Etap"),
    (f"<h1>Przystąpienie do sporządzenia {PLAN}</h1>", "html_index", "project", "mpzp_project", ops.PREPARATORY, "MPZP", "unknown", "MPZP 1", "Przystąpienie"),
    ('{"totalAmount":[0,14],"mpzpRegistry":[1,[[0,{"name":[0,"Uchwała Sośnica 2"]}],[0,{"name":[0," Druga "]}]]]}', "html_index", "registry", "planning_resolution", ops.BINDING, "MPZP", "unknown", "MPZP registry 1", "14 obowiązujących MPZP: Uchwała Sośnica 2; Druga"),
    ('{"mpzpRegistry":[1,[[0,{"name":[0,"Uchwała 10"]}]]]}', "html_index", "registry", "planning_resolution", ops.BINDING, "MPZP", "unknown", "MPZP registry 1", "lists 1 obowiązujących MPZP: Uchwała 10"),
    (f"UZASADNIENIE: przystąpienie do zmiany {PLAN}. Tereny Z14.1UP-UC, Z14.UP oraz Z14.ZD.", "pdf", "project", "mpzp_project", ops.PREPARATORY, "MPZP", "service", "MPZP 1", "UZASADNIENIE"),
    ('<app:profil xlink:title="strefa wielofunkcyjna z zabudową mieszkaniową" />', "gml", "gml", "planning_resolution", ops.DIRECTIONAL, "POG", "residential", "POG 1", "strefa"),
    (f"<h1>Zmiana {STUDY}</h1><p>etap uzgadniania</p>", "html_index", "change", "planning_resolution", ops.PREPARATORY, "SUiKZP", "unknown", "SUiKZP 1", "Zmiana"),
    ("<p>Zakończyliśmy etap zbierania uwag.</p><p>Informacje są w rejestrze planów ogólnych.</p>", "html_index", "phrase", "planning_resolution", ops.PREPARATORY, "POG", "unknown", "POG 1", "zbierania uwag"),
    ("<p>Informacje są w rejestrze planów ogólnych.</p>", "html_index", "phrase", "planning_resolution", ops.DIRECTIONAL, "POG", "unknown", "POG 1", "rejestrze"),
    (f"<p>{LONG}plan ogólny w opracowaniu{LONG}</p>", "html_index", "phrase", "planning_resolution", ops.PREPARATORY, "POG", "unknown", "POG 1", "plan ogólny w opracowaniu"),
    ("<p>Ogłoszenie - przystąpienie: w gminie powstaje plan ogólny</p>", "html_index", "phrase", "planning_resolution", ops.PREPARATORY, "POG", "unknown", "POG 1", "Ogłoszenie"),
    ("<p>Gmina Lipa zaprasza.</p>", "html_index"),
    ("", "html_index"),
    (None, "pdf"),
    ("<x>las i woda</x>", "gml"),
]


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(i, "1", "https://g.test/a/b", c[1], 0.9, c[0]) for i, c in enumerate(CASES)], SCHEMA)
    return {r.source_id: r for r in ops.page_signals(pages).collect()}


def test_cases(found):
    for i, (_, kind, *rest) in enumerate(CASES):
        if not rest:
            assert i not in found
            continue
        form, signal, status, raw, cls, plan, part = rest
        r = found[i]
        assert (r.form, r.signal_kind, r.signal_status, r.designation_raw, r.designation_normalized, r.plan_name, r.source_type, r.source_url) == (form, signal, status, raw, cls, plan, kind, "https://g.test/a/b"), CASES[i][0]
        assert part in r.description and (r.legal_weight > 0) == (cls in ("service", "residential"))


def test_snippet_is_what_stands_around(found):
    at = next(i for i, c in enumerate(CASES) if c[0] and LONG in c[0])
    text = re.sub(r"\s+", " ", f"{LONG}plan ogólny w opracowaniu{LONG}").strip()
    k = text.index("plan ogólny w opracowaniu")
    assert found[at].description == text[k - 180 : k + len("plan ogólny w opracowaniu") + 180].strip()


def test_first_rule_by_plain_search(spark):
    """For every pair of phrases, in both orders: the rule that comes first in the list decides, at its first place."""
    from pyspark.sql import functions as F

    samples = [x.replace("~", "i tak dalej").replace("*", "ych") for x, _ in ops.PHRASES]
    texts = [f"zz {a} yy {b} {a}" for a in samples for b in samples]

    def plain(text):
        for k, (phrase, _) in enumerate(ops.PHRASES):
            if m := re.search(ops.compiled(phrase), text):
                return k, m.start() + 1
        return None

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").select("i", ops.first_phrase(F.col("text")).alias("f")).collect()
    assert {r.i: (r.f.rule, r.f.at) for r in rows} == {i: plain(x) for i, x in enumerate(texts)}


def test_sync_replaces_managed_rows(spark):
    stored = "teryt_gmina string, signal_kind string, signal_status string, designation_raw string, designation_normalized string, source_type string, ref string, legal_weight decimal(6,2), note string"
    current = spark.createDataFrame([("1", "a", "b", "c", "d", "html_index", "old", None, "n"), ("2", "a", "b", "c", "d", "pdf", "other", None, "n"), ("1", "a", "b", "c", "d", "manual", "kept", None, "n")], stored)
    zones = spark.createDataFrame([(7, "1", "MN", "pog", "p"), (8, "1", "MN", "mpzp", "p"), (9, "2", "ZL", "studium", "p")], "zone_id long, teryt_gmina string, symbol string, plan_type string, plan_name string")
    pages = spark.createDataFrame([(1, "1", "https://g.test/x", "gml", 0.9, "<a>zabudowa mieszkaniowa</a>"), (2, "2", "https://g.test/y", "pdf", 0.9, "wniosków do planu ogólnego")], SCHEMA)
    everything = sorted((r.ref, r.source_type, r.note) for r in ops.run_signals(current, zones, pages).collect())
    assert everything == sorted([("kept", "manual", "n"), ("7", "planning_zone_passthrough", None), ("9", "planning_zone_passthrough", None), ("https://g.test/x", "html_index", None), ("https://g.test/y", "pdf", None)])
    one = sorted(r.ref for r in ops.run_signals(current, zones, pages, "1").collect())
    assert one == sorted(["kept", "other", "7", "https://g.test/x"])


def test_empty_table(spark):
    assert ops.page_signals(spark.createDataFrame([], SCHEMA)).count() == 0


def test_steps_of_a_page_are_not_repeated(spark):
    pages = spark.createDataFrame([(1, "1201011", "https://plan.test/", "html_index", 0.85, "<p>x</p>")], "source_id long, teryt_gmina string, source_url string, source_type string, confidence double, body string")
    plan = ops.page_signals(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("totalAmount") == 1  # no filter below the steps does them again
