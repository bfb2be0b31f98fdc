"""Planning signals from the pages, registers and documents of communes, and their sync with what zones say.

A page is cleaned and folded once.  Rules are data in order of precedence; phrases of a rule are looked for at every place of the
folded text in one pass, and the first rule that is found anywhere decides.  A page gives a signal for its register's row and
one for its section of plans in preparation; a page with neither gives one signal at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspark.functions import markup
from landspark.functions import planning as p
from landspark.functions.text import fold, html_to_text
from landspark.operators.backlog import resolve_href, signal_date
from landspark.operators.reports import refresh_signals

# fixed values: phrases of planning pages in order of precedence (folded; * any ending, ~ anything between), with the status that each gives
PREPARATORY, DIRECTIONAL, BINDING = "formal_preparatory", "formal_directional", "formal_binding"
PHRASES = (
    ("przystap* do sporzadzenia planu ogolnego", PREPARATORY),
    ("wniosk* do planu ogolnego", PREPARATORY),
    ("ogloszenie - przystapienie ~ plan ogolny", PREPARATORY),
    ("obecnie trwa sporzadzenie projektu planu", PREPARATORY),
    ("trwa sporzadzenie projektu planu", PREPARATORY),
    ("rozpoczeto procedure przetargowa ~ projektu planu ogolnego", PREPARATORY),
    ("wyloniono wykonawce projektu planu ogolnego", PREPARATORY),
    ("plan ogolny bedzie podstawa", DIRECTIONAL),
    ("etap opiniowania i uzgadniania", PREPARATORY),
    ("opiniowanie i uzgadnianie planu ogolnego", PREPARATORY),
    ("opiniowanie z gminn* komisj* urbanistyczno-architektoniczn*", PREPARATORY),
    ("zbieranie wniosk*", PREPARATORY),
    ("zakonczylismy etap zbierania uwag", PREPARATORY),
    ("rejestr* plan* ogoln*", DIRECTIONAL),
    ("konsultacji spolecznych planu ogolnego", PREPARATORY),
    ("przystapienie do planu ogolnego", PREPARATORY),
    ("plan ogolny w opracowaniu", PREPARATORY),
)
LOCAL_PLAN, STUDY = "miejscowego planu zagospodarowania przestrzennego", "studium uwarunkowan i kierunkow zagospodarowania przestrzennego"
SECTION, OPEN_SECTION, END_SECTION, IN_WORK = "pog - plan ogólny gminy</h2>", "<div>", "</div></div>", "w opracowaniu"
# fixed values: the plan types that zones pass on, with kind and status; the types of sources that a sync replaces; confidence of a section
PASSED_ON = {"pog": ("pog_zone", DIRECTIONAL), "studium": ("studium_zone", DIRECTIONAL)}
MANAGED = ("planning_zone_passthrough", "html_index", "pdf")
SECTION_CONFIDENCE = 0.70
#: Characters around a phrase, and characters of a description without one.
AROUND, SHORT = 180, 240
#: Characters between the halves of a phrase with a gap, at most: a page's length must not make a match quadratic.
GAP = 4000

#: A page's signal before its class, its plan's name and its address are made: what decides the class is ``about``, the plan's name is ``plan``
#: and the commune (null: the description), the address is that of the link ``href``.
CANDIDATE = "form string, signal_kind string, signal_status string, designation_raw string, about string, description string, plan string, uchwala_nr string, effective_date date, href string, source_confidence double, registry_count long"


def compiled(phrase: str) -> str:
    """A phrase as an expression over folded text, without capturing groups."""
    return r"\s+".join(w.replace("*", r"\w*") for w in phrase.split()).replace(r"\s+-\s+", r"\s*-\s*").replace(r"\s+~\s+", rf"[\s\S]{{0,{GAP}}}?")


def first_phrase(folded: Column) -> Column:
    """Struct (rule, at, size) of the first rule whose phrase the text holds, at its first place; null without any."""
    hits = F.regexp_extract_all(folded, F.lit("(?=(" + "|".join(compiled(x) for x, _ in PHRASES) + "))"), 1)

    def rule(hit: Column) -> Column:
        out = F.lit(len(PHRASES))
        for k in reversed(range(len(PHRASES))):
            out = F.when(hit.rlike("^" + compiled(PHRASES[k][0])), k).otherwise(out)
        return out

    ranked = F.transform(hits, lambda h, i: F.struct(rule(h).alias("rule"), i.alias("i"), F.position(h, folded).alias("at"), F.length(h).alias("size")))
    return F.array_min(ranked)


def _signal(**values: Column | str | None) -> Column:
    """A struct of CANDIDATE; fields that are not given are null."""
    fields = [f.split() for f in CANDIDATE.split(", ")]
    return F.struct(*((v if isinstance(v := values.get(n), Column) else F.lit(v).cast(t)).alias(n) for n, t in fields))


def page_signals(pages: DataFrame) -> DataFrame:
    """Signals of ``pages`` (source_id, teryt_gmina, source_url, source_type, confidence, body): the page's columns but its body, and what
    CANDIDATE and its comment name, with designation_normalized, plan_name, source_url and legal_weight.

    ``source_type`` is html_index, pdf or gml (``backlog.source_type``); of a pdf the body is its text.  A null or empty body, and
    one that holds no rule's words, gives no signal.  Rows that repeat a source give their own signals.
    """
    index, gml = F.col("source_type") == "html_index", F.col("source_type") == "gml"
    rows = pages.withColumn("_body", F.coalesce("body", F.lit(""))).withColumn("_clean", html_to_text(F.col("_body")))
    rows = rows.withColumn("_folded", fold(F.col("_clean"))).withColumn("_low", F.lower("_body"))
    begin = F.instr(F.col("_low"), SECTION)
    rows = rows.withColumn("_cells", F.when(index, markup.cells(F.get(markup.rows(F.col("_body"), "studium"), F.lit(0)), "cell"))).withColumn("_inner", F.when(index & (begin > 0), F.substring_index(F.substr(F.col("_body"), begin + len(SECTION)), END_SECTION, 1)))
    rows = rows.withColumn("_inner", F.when(F.startswith(F.lower("_inner"), F.lit(OPEN_SECTION)) & F.contains(F.lower("_inner"), F.lit(IN_WORK)), F.col("_inner")))
    rows = rows.withColumn("_texts", F.transform("_cells", html_to_text)).withColumn("_land", F.when(gml, p.designation_class(F.lit("POG"), F.col("_body"))))

    # a plan's file; a row of a register; the section of plans in preparation
    own, clean, folded = F.col("confidence"), F.col("_clean"), F.col("_folded")
    cell = lambda k: F.get("_texts", F.lit(k))
    words = F.trim(F.regexp_replace(F.translate(F.col("_body"), "<>=\"'", "     "), r"\s+", " "))
    special = F.array(
        F.when(F.col("_land").isin(*p.POSITIVE), _signal(form="gml", signal_kind="planning_resolution", signal_status=DIRECTIONAL, designation_raw="POG", about=F.col("_body"), description=F.left(words, F.lit(SHORT)), plan="POG", source_confidence=own)),
        F.when(
            F.size("_cells") >= 7,
            _signal(
                form="register", signal_kind="planning_resolution", signal_status=DIRECTIONAL, designation_raw=F.coalesce(F.nullif(cell(0), F.lit("")), F.lit("SUIKZP")), about=cell(1), description=cell(1), uchwala_nr=F.nullif(cell(6), F.lit("")),
                effective_date=signal_date(cell(4)), href=F.get("_cells", F.lit(8)), source_confidence=own,
            ),
        ),
        F.when(F.col("_inner").isNotNull(), _signal(form="section", signal_kind="planning_resolution", signal_status=PREPARATORY, designation_raw="POG", description=html_to_text(F.col("_inner")), plan="POG", href=F.col("_inner"), source_confidence=F.lit(SECTION_CONFIDENCE))),
    )
    rows = rows.withColumn("_special", F.array_compact(special))

    # one signal for a page with none of these: the study in force, a register's count, a project, a phrase
    rows = rows.withColumn("_phrase", F.when(F.size("_special") == 0, first_phrase(folded)))
    rows = rows.withColumn("_titles", F.when(F.contains(F.col("_low"), F.lit("mpzpregistry")), F.filter(F.transform(F.regexp_extract_all(F.col("_body"), F.lit(r'(?i)name"\s*:\s*\[0,"([^"]+)"\]'), 1), lambda x: F.trim(x)), lambda x: x != "")))
    rows = rows.withColumn("_total", F.coalesce(F.nullif(F.regexp_extract(F.col("_body"), r'(?i)totalAmount"\s*:\s*\[0,(\d{1,9})\]', 1), F.lit("")).cast("long"), F.size("_titles").cast("long")))
    study = F.instr(folded, STUDY)
    start = F.coalesce(F.col("_phrase")["at"], study)
    snippet = F.trim(F.substr(clean, F.greatest(start - AROUND, F.lit(1)), F.least(start - 1, F.lit(AROUND)) + F.coalesce(F.col("_phrase")["size"], F.lit(len(STUDY))) + AROUND))
    around = F.trim(F.substr(clean, F.greatest(study - AROUND, F.lit(1)), F.least(study - 1, F.lit(AROUND)) + len(STUDY) + AROUND))
    short = F.left(clean, F.lit(SHORT))
    titles = F.when(F.size("_titles") > 0, F.array_join(F.slice("_titles", 1, 3), "; ")).otherwise("Rejestr obowiązujących MPZP")
    listed = F.left(F.concat(F.lit("Geoportal registry lists "), F.col("_total").cast("string"), F.lit(" obowiązujących MPZP: "), titles), F.lit(SHORT))
    rows = rows.withColumn("_listed", F.when((F.col("_total") > 0) | (F.size("_titles") > 0), listed)).withColumn("_snippet", snippet)
    holds = lambda *words: folded.rlike("|".join(words))
    in_study, document = F.when(study > 0, "SUiKZP").otherwise("POG"), {"signal_kind": "planning_resolution", "source_confidence": own}
    status = F.get(F.array(*(F.lit(s) for _, s in PHRASES)), F.col("_phrase")["rule"])
    one = (
        F.when(holds(f"obowiazujace {STUDY}".replace(" ", r"\s+")), _signal(form="study", signal_status=DIRECTIONAL, designation_raw="SUiKZP", description=around, plan="SUiKZP", **document))
        .when(F.col("_titles").isNotNull() & F.col("_listed").isNotNull(), _signal(form="registry", signal_status=BINDING, designation_raw="MPZP", about=F.col("_listed"), description=F.col("_listed"), plan="MPZP registry", registry_count=F.col("_total"), **document))
        .when(holds(LOCAL_PLAN) & holds("przystap", "projekt"), _signal(form="project", signal_status=PREPARATORY, designation_raw="MPZP", about=clean, description=short, plan="MPZP", **document | {"signal_kind": "mpzp_project"}))
        .when((study > 0) & holds("zmian", "projekt", "uzgadnian"), _signal(form="change", signal_status=PREPARATORY, designation_raw="SUiKZP", about=clean, description=short, plan="SUiKZP", **document))
        .when(F.col("_phrase").isNotNull(), _signal(form="phrase", signal_status=status, designation_raw=in_study, about=F.col("_snippet"), description=F.col("_snippet"), plan=in_study, **document))
    )
    rows = rows.withColumn("_signals", F.when(F.size("_special") > 0, F.col("_special")).otherwise(F.array_compact(F.array(one))))
    keep = [c for c in pages.columns if c not in ("body", "confidence", "source_url")]
    # a slice of all of them: of a bare column Spark would ask, below all the steps above and by doing them over and over, whether it is empty
    out = rows.select(*keep, F.col("source_url").alias("_url"), F.explode(F.slice("_signals", 1, markup.MANY)).alias("s")).select(*keep, "_url", "s.*")
    out = out.withColumn("designation_normalized", p.designation_class(F.upper("designation_raw"), F.col("about"))).withColumn("source_url", F.coalesce(resolve_href(F.col("_url"), F.col("href")), F.col("_url")))
    out = out.withColumn("plan_name", F.coalesce(F.concat("plan", F.lit(" "), "teryt_gmina"), "description")).drop("about", "href", "plan", "_url")
    return out.withColumn("legal_weight", p.signal_weight(F.col("signal_kind"), F.col("designation_normalized"), F.col("signal_status")))


def zone_signals(zones: DataFrame) -> DataFrame:
    """Signals that zones of general plans and studies pass on: teryt_gmina, signal_kind, signal_status, designation, plan_name, zone_id, weight."""
    kinds = F.create_map(*[F.lit(x) for k, v in PASSED_ON.items() for x in (k, v[0])])
    statuses = F.create_map(*[F.lit(x) for k, v in PASSED_ON.items() for x in (k, v[1])])
    described = F.col("description") if "description" in zones.columns else F.lit(None).cast("string")
    rows = zones.filter(F.col("plan_type").isin(*PASSED_ON)).select(
        "teryt_gmina", F.element_at(kinds, F.col("plan_type")).alias("signal_kind"), F.element_at(statuses, F.col("plan_type")).alias("signal_status"), F.col("symbol").alias("designation_raw"),
        p.designation_class(F.col("symbol"), described).alias("designation_normalized"), described.alias("description"), "plan_name", F.lit("planning_zone_passthrough").alias("source_type"),
        F.lit(1.0).alias("source_confidence"), F.col("zone_id").cast("string").alias("ref"),
    )
    return rows.withColumn("legal_weight", p.signal_weight(F.col("signal_kind"), F.col("designation_normalized"), F.col("signal_status")))


def run_signals(current: DataFrame, zones: DataFrame, pages: DataFrame, commune: str | None = None) -> DataFrame:
    """The next table of signals: rows of managed source types (of one commune, if given) give way to those of zones and pages.

    A gml file counts as an index page, as its signal's source type says.  ``current`` has the columns of ``zone_signals``, in any order; others
    of its columns are null in fresh rows.
    """
    if commune is not None:
        zones, pages = zones.filter(F.col("teryt_gmina") == commune), pages.filter(F.col("teryt_gmina") == commune)
    fresh = zone_signals(zones)
    kind = F.when(F.col("source_type") == "gml", "html_index").otherwise(F.col("source_type"))
    read = page_signals(pages).withColumn("source_type", kind).withColumn("ref", F.col("source_url")).select(*fresh.columns)
    fresh = fresh.unionByName(read)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in current.schema.fields if f.name not in fresh.columns]
    return refresh_signals(current, fresh.select(*(c for c in fresh.columns if c in current.columns), *missing).select(current.columns), list(MANAGED), commune)
