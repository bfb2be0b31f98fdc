"""Backlog of sources and communes, readiness of plans, page checks, evidence, reviews and coverage back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.functions.text import fold, html_to_text
from landspark.operators.reports import collect_polygons
from landspark.operators.signals import with_benchmark
from landspark.operators.tables import newest

# fixed values: source types, states and advice
ZONES, INDEX = "planning_zone_passthrough", "html_index"
LEAST_SAMPLE = 5


def _none(known: Column) -> Column:
    return F.coalesce(F.size(known), F.lit(0)) <= 0


def next_best_source(known: Column, html_status: Column) -> Column:
    """Where to look next for a commune with these source types (an array) and this state of its page index."""
    return (
        F.when(html_status == "upstream_broken", "manual_research")
        .when(_none(known), "wykazplanow")
        .when(~F.array_contains(known, ZONES), "studium_or_pog_geometry")
        .when(F.array_contains(known, INDEX), "mpzp_project_or_resolution")
        .otherwise("heuristics_tuning")
    )


def operator_status(known: Column, html_status: Column) -> Column:
    return (
        F.when(html_status == "upstream_broken", "upstream_broken")
        .when(_none(known), "ready")
        .when(~F.array_contains(known, ZONES), "needs_geometry_source")
        .when(html_status == "live", "live")
        .otherwise("partial")
    )


def reliable_benchmark(sample: Column, median: Column) -> Column:
    return F.coalesce((sample >= LEAST_SAMPLE) & median.isNotNull(), F.lit(False))


def source_backlog(near: DataFrame, sources: DataFrame, probes: DataFrame) -> DataFrame:
    """Communes near the threshold with their source types, the state of their page index, status and advice.

    ``near``: teryt_gmina, ...; ``sources``: teryt_gmina, known (array); ``probes``: teryt_gmina, html_status, html_error; one
    row a commune in each.  A commune that a table lacks has nulls from it.
    """
    rows = near.join(sources.select("teryt_gmina", F.array_sort("known").alias("known")), "teryt_gmina", "left").join(probes.select("teryt_gmina", "html_status", "html_error"), "teryt_gmina", "left")
    known, status = F.col("known"), F.col("html_status")
    return rows.withColumn("next_best_source_type", next_best_source(known, status)).withColumn("operator_status", operator_status(known, status))


def benchmark_gaps(candidates: DataFrame, benchmark: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Of the first ``limit`` communes by code, the best candidate where its price is missing or its benchmark can't be relied on."""
    best = newest(candidates.filter("overall_score >= 20"), ["teryt_gmina"], [F.desc("overall_score"), F.asc(key)])
    rows = with_benchmark(best.orderBy("teryt_gmina").limit(limit), benchmark).withColumn("reliable", reliable_benchmark(F.col("sample_size"), F.col("median")))
    return rows.filter(F.col("price_per_m2_zl").isNull() | ~F.col("reliable"))


# fixed values: columns of the backlog, in order
BACKLOG = (
    "backlog_family", "teryt_gmina", "bucket", "why_no_lead", "parcel_count", "planning_zones", "delta_rows", "max_overall_score", "known_sources", "next_best_source_type", "operator_status", "covered_via",
    "localities", "next_action", "sample_url", "last_assessment_at", "last_source_sync_at",
)


def province_backlog(gaps: DataFrame, future: DataFrame) -> DataFrame:
    """Coverage gaps and future-signal rows in one shape of 17 columns; what a row's family lacks is null."""
    both = gaps.withColumn("backlog_family", F.lit("coverage_gap")).unionByName(future.withColumn("backlog_family", F.lit("future_signal")), allowMissingColumns=True)
    return both.select(*(F.col(c) if c in both.columns else F.lit(None).cast("string").alias(c) for c in BACKLOG))


def plan_state(axes_suspect: Column, n_matches: Column, has_legend: Column, legend_known: Column) -> Column:
    """Readiness of a plan's service: its axes, then whether parcels lie in it and its legend is known."""
    return F.when(axes_suspect, "bbox_axis_suspect").when((n_matches > 0) & has_legend & legend_known, "ready").when((n_matches > 0) & has_legend, "manual_override_required").otherwise("source_discovered")


def probe_state(designation: Column, legend_entries: Column) -> Column:
    return F.when(F.coalesce(designation, F.lit("")) != "", "ready").when(F.coalesce(legend_entries, F.lit(0)) <= 0, "legend_missing_semantics").otherwise("manual_override_required")


def source_type(url: Column, content_type: Column) -> Column:
    """pdf, gml or html_index, by the address's ending or the type that the server names."""
    low, kind = F.lower(url), F.lower(F.coalesce(content_type, F.lit("")))
    has = lambda word: F.contains(kind, F.lit(word))
    return F.when(F.endswith(low, F.lit(".pdf")) | has("application/pdf"), "pdf").when(F.endswith(low, F.lit(".gml")) | has("gml") | has("xml"), "gml").otherwise("html_index")


# fixed values: what error pages say
ERROR_PAGE = "(?iu)błąd połączenia|blad polaczenia|connection error"
NO_BODY, ERROR_BODY = "HTML index returned an empty response body", "HTML index returned an operator error page: "


def page_error(html: Column) -> Column:
    """Why a page can't be used as an index; null if it can."""
    text = html_to_text(html)
    return F.when(text == "", NO_BODY).when(text.rlike(ERROR_PAGE), F.concat(F.lit(ERROR_BODY), F.left(text, F.lit(160))))


def resolve_href(base: Column, fragment: Column) -> Column:
    """The first link of a fragment of a page, as a whole address; null without one."""
    href = F.nullif(F.regexp_extract(F.coalesce(fragment, F.lit("")), r"(?i)href=['\"]([^'\"]+)['\"]", 1), F.lit(""))
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    top = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    goes, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"[?#].*$", 0)
    whole = F.when(goes == "", path).when(F.startswith(goes, F.lit("/")), goes).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), goes))
    step = lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))
    parts = F.split(F.regexp_replace(F.regexp_replace(whole, "^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    plain = F.concat(top, F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), rest)
    return F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^[a-zA-Z]+:", 0), href)).otherwise(plain)


def signal_date(text: Column) -> Column:
    """A date in one of three notations; null of anything else."""
    return F.coalesce(*(F.when(text.rlike(shape), F.try_to_date(text, form)) for shape, form in ((r"^\d{4}-", "yyyy-M-d"), (r"^\d{4}/", "yyyy/M/d"), (r"^\d{1,2}\.", "d.M.yyyy"))))


# fixed values: words that no locality holds (folded), and the confidence from which a number counts
SUSPECT = ("komornik", "kancelar", "sad", "sygnatur", "numerze", "rejonowym", r"ul\.", "ulica", "adres")
SURE = 0.70


def triage(number: Column, confidence: Column, locality: Column) -> Column:
    """Why a notice's extraction needs a second look; null if it doesn't."""
    key = F.trim(fold(F.coalesce(locality, F.lit(""))))
    usable = (F.length(key) >= 3) & ~key.rlike(r"^\d+$") & ~key.rlike("|".join(SUSPECT))
    return F.when(number.isNull(), "missing_parcel").when(confidence < SURE, "low_regex_confidence").when(~usable, "missing_locality")


def evidence_steps(parcels: DataFrame, listings: DataFrame, signals: DataFrame, assessments: DataFrame) -> DataFrame:
    """The evidence of each assessed parcel, a row a step: parcel_id, position (from 1), step, ref, url.

    The listing's address (where there is one), the parcel, its signals in the order of their dates, the assessment.  ``parcels``,
    ``listings`` (parcel_id, listing_id, source_url) and ``assessments`` have one row a parcel at most.
    """
    from pyspark.sql import Window

    none = F.lit(None).cast("string")
    row = lambda turn, at, step, ref, url=none: ("parcel_id", F.lit(turn).alias("turn"), at.cast("timestamp").alias("at"), F.lit(step).alias("step"), F.col(ref).cast("string").alias("ref"), url.alias("url"))
    no_time = F.lit(None)
    wanted = assessments.select("parcel_id")
    steps = (
        listings.filter("source_url IS NOT NULL").select(*row(0, no_time, "source", "listing_id", F.col("source_url")))
        .unionByName(parcels.select(*row(1, no_time, "parcel", "parcel_id")))
        .unionByName(signals.filter("parcel_id IS NOT NULL").select(*row(2, F.col("created_at"), "signal", "signal_id", F.col("source_url"))))
        .join(wanted, "parcel_id", "left_semi")
        .unionByName(assessments.select(*row(3, no_time, "future_assessment", "parcel_id")))
    )
    order = Window.partitionBy("parcel_id").orderBy("turn", "at", F.col("ref").cast("long"))
    return steps.withColumn("position", F.row_number().over(order)).select("parcel_id", "position", "step", "ref", "url")


def backfill_coverage(parcels: DataFrame, requests: DataFrame, designation: str, description: str, prefix: str = "Formal coverage", most: int = 1000) -> DataFrame:
    """Synthetic zones of the communes in ``requests`` (teryt_gmina) from their parcels: one plan a commune, in parts of about ``most`` parcels.

    They take the place of the commune's former ones by ``source_wfs_url`` (``tables.replace_rows``).  Communes without parcels have none.
    """
    own = parcels.join(requests.select("teryt_gmina").distinct(), "teryt_gmina", "left_semi")
    parts = collect_polygons(own, ["teryt_gmina"], "parcel_id", most)
    return parts.select(
        "teryt_gmina", "part", F.lit("mpzp").alias("plan_type"), F.concat_ws(" ", F.lit(prefix), "teryt_gmina").alias("plan_name"), F.concat(F.lit("FORMAL/"), "teryt_gmina").alias("resolution"),
        F.lit(designation).alias("symbol"), F.lit(description).alias("description"), F.concat(F.lit("synthetic://formal_backlog/"), "teryt_gmina").alias("source_wfs_url"),
        F.col("n_parts").alias("n_parcels"), g.geom_hash(F.col("geom")).alias("geom_hash"), "geom",
    )


# fixed values: labels of the corpus
LABELS = ("true_positive", "tempting_false_positive", "true_negative")


def load_corpus(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus rows with their texts trimmed, and those rejected, with a reason; empty band, notes and hint are null."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    clean = rows.select(*(text(c).alias(c) for c in ("parcel_id", "province", "label")), *(F.nullif(text(c), F.lit("")).alias(c) for c in ("expected_band", "notes", "source_hint")))
    reason = F.when((F.col("parcel_id") == "") | (F.col("province") == "") | (F.col("label") == ""), "missing_field").when(~F.col("label").isin(*LABELS), "unknown_label")
    marked = clean.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def apply_reviews(corpus: DataFrame, reviews: DataFrame, assessments: DataFrame | None = None) -> DataFrame:
    """The corpus with the reviewers' labels, bands and notes where they gave any; 'none' as a band clears it.

    ``reviews``: parcel_id (unique), review_label, review_band, review_notes.  With ``assessments`` (parcel_id, source_hint) reviewed
    parcels that the corpus lacks are appended.
    """
    said = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    given = reviews.select("parcel_id", said("review_label").alias("_l"), said("review_band").alias("_b"), said("review_notes").alias("_n")).filter("coalesce(_l, _b, _n) IS NOT NULL")
    band = F.when(F.lower("_b") != "none", F.col("_b"))
    out = corpus.join(given, "parcel_id", "left").select(
        "parcel_id", F.coalesce("_l", "label").alias("label"), F.when(F.col("_b").isNull(), F.col("expected_band")).otherwise(band).alias("expected_band"), F.coalesce("_n", "notes").alias("notes"), "source_hint"
    )
    if assessments is None:
        return out
    absent = given.join(corpus.select("parcel_id"), "parcel_id", "left_anti").join(assessments.select("parcel_id", "source_hint"), "parcel_id")
    return out.unionByName(absent.select("parcel_id", F.col("_l").alias("label"), band.alias("expected_band"), F.coalesce("_n", F.lit("Manual review appended from DB.")).alias("notes"), "source_hint"))
