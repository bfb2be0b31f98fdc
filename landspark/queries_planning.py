"""Registered queries of planning pages: all pages given, and pages of planning offices derived from the customers' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck, gmina, pick
from landspark.operators import signal_pages as ops
from landspark.queries import query

K = "cast(c_custkey AS varchar(20))"
STUDY = "studium uwarunkowań i kierunków zagospodarowania przestrzennego"
ROW = (
    '<table><tr class="x"><td class="cell">a</td></tr><tr class="row studium"><td class="cell"></td><td class="cell"><b>Studium gminy ', '</b></td><td class="cell">c</td><td class="cell">d</td><td class="cell">12.03.2021</td>'
    '<td class="cell">f</td><td class="cell">XII/', '/21</td><td class="cell">h</td><td class="cell"><a href="../akty/', '.pdf">akt</a></td></tr></table>',
)
SECTION = '<div><h2>POG - plan ogólny gminy</h2><div>Plan nr ', ' w opracowaniu, <a href="/pog">więcej</a></div></div></div>'
#: Bodies by the key modulo 16, as pieces between which the key stands.
BODIES = (
    ("<h1>Plan ogólny</h1><p>Rada podjęła uchwałę nr ", " w sprawie przystąpienia do sporządzenia planu ogólnego.</p>"),
    ("<p>Sprawa ", ": można składać wnioski do planu ogólnego; rejestr planów ogólnych prowadzi minister.</p>"),
    ("<p>Obecnie   trwa sporządzenie projektu planu nr ", ".</p>"),
    ("<div>Etap opiniowania i uzgadniania</div><div>nr ", "</div>"),
    ("<p>Plan ogólny będzie podstawą wydawania decyzji, tom ", ".</p>"),
    (f"<h1>Obowiązujące {STUDY} gminy</h1><p>tom ", "</p>"),
    ("<h1>Przystąpienie do sporządzenia miejscowego planu zagospodarowania przestrzennego nr ", "</h1>"),
    ("<p>Zmiana nr ", f": {STUDY}, etap uzgadniania.</p>"),
    ('{"mpzpData":[0,{"totalAmount":[0,14],"mpzpRegistry":[1,[[0,{"name":[0,"Uchwała ', '"]}],[0,{"name":[0,"Uchwała druga"]}]]]}]}'),
    ROW,
    SECTION,
    (ROW[0], ROW[1], ROW[2], ROW[3] + SECTION[0], SECTION[1]),
    ('<app:profil xlink:title="strefa z zabudową mieszkaniową ', '" />'),
    ("<p>Aktualności gminy nr ", ": dożynki.</p>"),
    ("Uzasadnienie ", " zmiany miejscowego planu zagospodarowania przestrzennego; projekt obejmuje tereny Z14.1UP-UC."),
    ("<p>Opiniowanie z Gminną Komisją Urbanistyczno-Architektoniczną, sprawa ", ".</p>"),
)
_text = lambda s: "'" + s.replace("'", "''") + "'"
BODY = "CASE c_custkey % 16 " + " ".join(f"WHEN {i} THEN concat({', '.join(x for k, s in enumerate(b) for x in ([K] if k else []) + [_text(s)])})" for i, b in enumerate(BODIES)) + " END"
PLANNING = f"""SELECT c_custkey AS source_id, {gmina('c_custkey', 'c_custkey')} AS teryt_gmina, concat('https://plan.test/gmina/', {K}, '/wykaz') AS source_url,
  {pick('c_custkey % 16', *(['html_index'] * 12), 'gml', 'html_index', 'pdf', 'html_index')} AS source_type, 0.85 AS confidence, {BODY} AS body FROM customer"""


def _pages(spark, sf_dir):
    """The planning pages, and the given pages as pages of an office each."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").select((-F.col("page_id") - 1).alias("source_id"), F.lit("1261011").alias("teryt_gmina"), F.col("url").alias("source_url"), F.lit("html_index").alias("source_type"), F.lit(0.85).alias("confidence"), F.col("html").alias("body"))
    return spark.sql(PLANNING.replace("{", "{{").replace("}", "}}").replace("FROM customer", "FROM {base}"), base=customer).withColumn("confidence", F.col("confidence").cast("double")).unionByName(given)


COLUMNS = "source_id, teryt_gmina, source_type, form, signal_kind, signal_status, designation_raw, designation_normalized, description, plan_name, uchwala_nr, effective_date, source_url, source_confidence, registry_count, legal_weight"
#: Expected rows by the key modulo 16: form, kind, status, designation, class, description, plan, weight.
_P, _D, _B = ops.PREPARATORY, ops.DIRECTIONAL, ops.BINDING
EXPECTED = {
    0: [("phrase", "planning_resolution", _P, "POG", "unknown", "'Plan ogólny Rada podjęła uchwałę nr ' || k || ' w sprawie przystąpienia do sporządzenia planu ogólnego.'", "POG ", 0)],
    1: [("phrase", "planning_resolution", _P, "POG", "unknown", "'Sprawa ' || k || ': można składać wnioski do planu ogólnego; rejestr planów ogólnych prowadzi minister.'", "POG ", 0)],
    2: [("phrase", "planning_resolution", _P, "POG", "unknown", "'Obecnie trwa sporządzenie projektu planu nr ' || k || '.'", "POG ", 0)],
    3: [("phrase", "planning_resolution", _P, "POG", "unknown", "'Etap opiniowania i uzgadniania nr ' || k", "POG ", 0)],
    4: [("phrase", "planning_resolution", _D, "POG", "unknown", "'Plan ogólny będzie podstawą wydawania decyzji, tom ' || k || '.'", "POG ", 0)],
    5: [("study", "planning_resolution", _D, "SUiKZP", "unknown", f"'Obowiązujące {STUDY} gminy tom ' || k", "SUiKZP ", 0)],
    6: [("project", "mpzp_project", _P, "MPZP", "unknown", "'Przystąpienie do sporządzenia miejscowego planu zagospodarowania przestrzennego nr ' || k", "MPZP ", 0)],
    7: [("change", "planning_resolution", _P, "SUiKZP", "unknown", f"'Zmiana nr ' || k || ': {STUDY}, etap uzgadniania.'", "SUiKZP ", 0)],
    8: [("registry", "planning_resolution", _B, "MPZP", "unknown", "'Geoportal registry lists 14 obowiązujących MPZP: Uchwała ' || k || '; Uchwała druga'", "MPZP registry ", 0)],
    9: [("register", "planning_resolution", _D, "SUIKZP", "unknown", "'Studium gminy ' || k", None, 0)],
    10: [("section", "planning_resolution", _P, "POG", "unknown", "'Plan nr ' || k || ' w opracowaniu, więcej'", "POG ", 0)],
    12: [("gml", "planning_resolution", _D, "POG", "residential", "'app:profil xlink:title strefa z zabudową mieszkaniową ' || k || ' /'", "POG ", 10)],
    14: [("project", "mpzp_project", _P, "MPZP", "service", "'Uzasadnienie ' || k || ' zmiany miejscowego planu zagospodarowania przestrzennego; projekt obejmuje tereny Z14.1UP-UC.'", "MPZP ", 10)],
    15: [("phrase", "planning_resolution", _P, "POG", "unknown", "'Opiniowanie z Gminną Komisją Urbanistyczno-Architektoniczną, sprawa ' || k || '.'", "POG ", 0)],
}
EXPECTED[11] = EXPECTED[9] + EXPECTED[10]
_ARMS = "\nUNION ALL ".join(
    f"SELECT source_id, teryt_gmina, source_type, '{form}' AS form, '{kind}' AS signal_kind, '{status}' AS signal_status, '{raw}' AS designation_raw, '{cls}' AS designation_normalized, {text} AS description, "
    f"{'NULL' if plan is None else repr(plan) + ' || teryt_gmina'} AS plan, {weight}::DECIMAL(6,2) AS legal_weight, k FROM s WHERE source_id % 16 = {i}"
    for i, many in sorted(EXPECTED.items()) for form, kind, status, raw, cls, text, plan, weight in many
)
EXPECTED_SQL = f"""s AS (SELECT source_id, teryt_gmina, source_url, source_type, source_id::VARCHAR AS k FROM ({PLANNING})), e AS ({_ARMS}),
signals AS (SELECT e.source_id, e.teryt_gmina, e.source_type, form, signal_kind, signal_status, designation_raw, designation_normalized, description, coalesce(plan, description) AS plan_name,
  CASE WHEN form = 'register' THEN 'XII/' || k || '/21' END AS uchwala_nr, CASE WHEN form = 'register' THEN DATE '2021-03-12' END AS effective_date,
  CASE form WHEN 'register' THEN 'https://plan.test/gmina/akty/' || k || '.pdf' WHEN 'section' THEN 'https://plan.test/pog' ELSE 'https://plan.test/gmina/' || k || '/wykaz' END AS source_url,
  CASE WHEN form = 'section' THEN 0.7 ELSE 0.85 END::DOUBLE AS source_confidence, CASE WHEN form = 'registry' THEN 14 END::BIGINT AS registry_count, legal_weight FROM e)"""


@query("h21_page_signals", f"WITH {EXPECTED_SQL} SELECT * FROM signals")
def h21_page_signals(spark, sf_dir):
    """Planning signals of all given pages, which name no plan, and of the derived pages of planning offices."""
    return ops.page_signals(_pages(spark, sf_dir)).selectExpr(*COLUMNS.split(", "))


CLASS = "CASE WHEN symbol IN ('MN', '19.MN', 'MN.1', 'MW', 'ML') THEN 'residential' WHEN symbol IN ('U/MN-3', '1MNU', 'MW/U.1') THEN 'mixed_residential' WHEN symbol = 'U' THEN 'service' WHEN symbol LIKE 'KD%' THEN 'road' WHEN symbol = 'ZL' THEN 'forest' WHEN symbol = 'WS' THEN 'water' WHEN symbol = 'ZP' THEN 'green' WHEN symbol = 'P' THEN 'industrial' ELSE 'agricultural' END"
ZONE = f"""SELECT teryt_gmina, plan_type || '_zone' AS signal_kind, 'formal_directional' AS signal_status, symbol AS designation_raw, c AS designation_normalized, 'planning_zone_passthrough' AS source_type, zone_id::VARCHAR AS ref,
  CASE WHEN c IN ('forest', 'water', 'green', 'industrial') THEN -40 WHEN c = 'agricultural' THEN -20 WHEN c = 'road' THEN 0 WHEN plan_type = 'pog' THEN 55 ELSE 20 END::DECIMAL(6,2) AS legal_weight FROM (SELECT *, {CLASS} AS c FROM fx_zones WHERE plan_type IN ('pog', 'studium'))"""
STORED = "teryt_gmina, signal_kind, signal_status, designation_raw, designation_normalized, source_type, ref, legal_weight"


@query(
    "k5_run_signals",
    f"""WITH {duck('fx_zones', 'fx_signals')}, {EXPECTED_SQL}
SELECT teryt_gmina, signal_kind, signal_status, NULL::VARCHAR AS designation_raw, designation_normalized, CASE source_type WHEN 'html' THEN 'html_index' ELSE source_type END AS source_type, signal_id::VARCHAR AS ref, 0::DECIMAL(6,2) AS legal_weight FROM fx_signals WHERE source_type = 'gison'
UNION ALL {ZONE}
UNION ALL SELECT teryt_gmina, signal_kind, signal_status, designation_raw, designation_normalized, CASE source_type WHEN 'gml' THEN 'html_index' ELSE source_type END, source_url, legal_weight FROM signals""",
)
def k5_run_signals(spark, sf_dir):
    """The table of signals after a sync: rows of managed sources replaced by those of all zones and pages (K5: I2, I3, H21, J6)."""
    kind = F.when(F.col("source_type") == "html", "html_index").otherwise(F.col("source_type"))
    current = derived(spark, sf_dir, "fx_signals").select(
        "teryt_gmina", "signal_kind", "signal_status", F.lit(None).cast("string").alias("designation_raw"), "designation_normalized", kind.alias("source_type"), F.col("signal_id").cast("string").alias("ref"), F.lit(0).cast("decimal(6,2)").alias("legal_weight")
    )
    return ops.run_signals(current, derived(spark, sf_dir, "fx_zones"), _pages(spark, sf_dir)).selectExpr(*STORED.split(", "))
