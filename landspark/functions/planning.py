"""Planning symbols, signal classes and lead rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: land-use codes, zone symbols and designation classes
AGRICULTURAL = ("R", "Ł", "Ps", "Ls", "Lz", "S", "N", "W", "dr")
BUILT = ("B", "Ba", "Bi", "Bp", "K")
BUILDABLE = ("MN", "MW", "ML", "MR", "U", "UC", "UK", "MU", "UM", "MN/U", "U/MN", "MNU", "U/MW", "MW/U")
POSITIVE = ("residential", "mixed_residential", "service")
HARD_NEGATIVE = ("forest", "water", "green", "cemetery", "infrastructure", "industrial")
RESIDENTIAL_SYMBOLS = ("MN", "MW", "ML", "MR")
SERVICE_SYMBOLS = ("U", "UC", "UK", "UT", "UH", "US", "UI", "UA", "UN", "UZ", "CU", "UP")
MIXED_SYMBOLS = ("MU", "UM", "MNU", "MN/U", "U/MN", "U/MW", "MW/U")
DOCUMENTS = ("POG", "SUIKZP", "STUDIUM", "MPZP")
UPPER = "A-ZĄĆĘŁŃÓŚŹŻ"


def normalise_symbol(symbol: Column) -> Column:
    """``19.MN`` to ``MN``, ``U/MN-3`` to ``U/MN``; null to the empty string."""
    bare = F.regexp_replace(F.upper(F.coalesce(symbol, F.lit(""))), r"\s+", "")
    mixed = F.regexp_replace(bare, f"(?<=[{UPPER}])-(?=[{UPPER}])", "/")
    clean = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "^[0-9._-]+", ""), "[._-]*[0-9]+$", ""), "^[._-]+|[._-]+$", "")
    return F.array_join(F.filter(F.transform(F.split(mixed, "/"), clean), lambda p: p != ""), "/")


def is_buildable(symbol: Column) -> Column:
    return normalise_symbol(symbol).isin(*BUILDABLE)


def is_mixed(symbol: Column) -> Column:
    """A zone of mixed or service use, by its symbol as written."""
    return F.upper(symbol).isin(*MIXED_SYMBOLS) | F.upper(symbol).rlike("/MN|/U|MN|MW")


def is_road(symbol: Column) -> Column:
    return F.upper(symbol).startswith("KD")


def _holds(text: Column, *symbols: str) -> Column:
    """Whether one of the symbols stands in upper-case prose with no letter on either side."""
    return text.rlike(f"(?<![{UPPER}])(?:{'|'.join(symbols)})(?![{UPPER}])")


def designation_class(raw: Column, description: Column) -> Column:
    """One of twelve classes of land designation from a symbol and a description; the first rule that holds decides."""
    desc = F.lower(F.trim(F.coalesce(description, F.lit(""))))
    prose = F.upper(desc)
    symbol = normalise_symbol(F.trim(F.coalesce(raw, F.lit(""))))
    tokens = F.split(F.translate(symbol, "-", "/"), r"[/,;\s]+")
    says = lambda *words: _any([desc.contains(w) for w in words])
    in_prose = _holds(prose, *RESIDENTIAL_SYMBOLS, *SERVICE_SYMBOLS, *MIXED_SYMBOLS)
    # a mixed symbol in prose also counts as its two halves where it is written with a slash
    residential = F.arrays_overlap(tokens, F.array(*map(F.lit, RESIDENTIAL_SYMBOLS))) | _holds(prose, *RESIDENTIAL_SYMBOLS)
    service = F.arrays_overlap(tokens, F.array(*map(F.lit, SERVICE_SYMBOLS))) | _holds(prose, *SERVICE_SYMBOLS)
    buildable = symbol.isin(*BUILDABLE)
    return (
        F.when(buildable & (symbol.contains("/") | symbol.isin("MU", "UM", "MNU")), "mixed_residential")
        .when(buildable & symbol.startswith("U"), "service")
        .when(buildable, "residential")
        .when(symbol.isin(*DOCUMENTS) & ~in_prose & ~says("mieszk", "usług"), "unknown")
        .when(symbol.isin(*MIXED_SYMBOLS) | (says("mieszk") & says("usług")), "mixed_residential")
        .when(residential & service, "mixed_residential")
        .when(residential | says("mieszk"), "residential")
        .when(service | says("usług"), "service")
        .when(symbol.startswith("KD") | says("droga"), "road")
        .when(symbol.startswith("ZL") | says("las"), "forest")
        .when(symbol.startswith("WS") | says("wod"), "water")
        .when(symbol.startswith("ZP") | says("ziele"), "green")
        .when(symbol.startswith("P") | says("produk", "przemys"), "industrial")
        .when(symbol.startswith("R") | says("rol", "sad"), "agricultural")
        .when(symbol.startswith("C") | says("cmentar"), "cemetery")
        .when(symbol.startswith("IT") | says("infrastr"), "infrastructure")
        .otherwise("unknown")
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def signal_weight(kind: Column, designation: Column, status: Column) -> Column:
    d = F.lower(F.trim(F.coalesce(designation, F.lit("unknown"))))
    preparatory = kind.isin("mpzp_project", "planning_resolution") & (status != "heuristic")
    points = (
        F.when(d.isin(*HARD_NEGATIVE), -40)
        .when((d == "agricultural") & (status != "heuristic"), -20)
        .when(preparatory, F.when(d.isin(*POSITIVE), 10).otherwise(0))
        .when(~d.isin(*POSITIVE), 0)
        .when(kind == "pog_zone", 55)
        .when(kind == "pog_ouz", 30)
        .when(kind == "studium_zone", 20)
        .otherwise(0)
    )
    return points.cast("decimal(6,2)")


def signal_label(kind: Column, designation: Column, plan_name: Column) -> Column:
    plan = F.when(F.coalesce(plan_name, F.lit("")) != "", F.concat(F.lit(" ("), plan_name, F.lit(")"))).otherwise("")
    return F.concat(kind, F.lit(": "), F.coalesce(F.nullif(designation, F.lit("")), F.lit("unknown")), plan)


def open_land(current_use: Column, case_insensitive_use: bool = False) -> Column:
    """Whether a parcel's use is not that of land that is built on; unknown use passes."""
    use = F.trim(F.coalesce(current_use, F.lit("")))
    within = (lambda codes: F.upper(use).isin(*[c.upper() for c in codes])) if case_insensitive_use else (lambda codes: use.isin(*codes))
    return (use == "") | (F.upper(use) == "R_UNKNOWN") | (~within(BUILT) & within(AGRICULTURAL))


def genuine_upgrade(symbol: Column, current_use: Column, case_insensitive_use: bool = False) -> Column:
    """A buildable zone on land that is not built on; unknown use passes."""
    return is_buildable(symbol) & open_land(current_use, case_insensitive_use)


def enough(coverage: Column, area: Column) -> Column:
    """Whether an overlap is large enough for a lead."""
    return (coverage >= 30) | (area >= 500)


def enough_hundredths(area, coverage):
    """``enough`` of numbers of hundredths, in numpy."""
    return (coverage >= 3000) | (area >= 50000)


def qualifies(symbol: Column, current_use: Column, coverage: Column, area: Column, case_insensitive_use: bool = False) -> Column:
    return genuine_upgrade(symbol, current_use, case_insensitive_use) & enough(coverage, area)


def delta_score(coverage: Column) -> Column:
    return F.when(coverage >= 70, 0.95).when(coverage >= 50, 0.90).when(coverage >= 30, 0.85).otherwise(0.50).cast("decimal(3,2)")


def priority(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "high").when(confidence >= 0.75, "medium").otherwise("low")


def price_per_m2(price: Column, area: Column) -> Column:
    """Rounded half to even, null without a price or an area."""
    return F.when(area > 0, F.bround(price.cast("decimal(20,6)") / area.cast("decimal(20,6)"), 2)).cast("decimal(12,2)")


def price_signal(price: Column, per_m2: Column) -> Column:
    return F.when(price.isNull() & per_m2.isNull(), "missing").when((price < 1000) | (per_m2 < 5) | (per_m2 > 20000), "suspicious").otherwise("reliable")


METRICS = ("price_zl", "price_per_m2_zl", "area_m2", "max_buildable_area_m2", "max_coverage_pct", "dominant_przeznaczenie")


def missing_metrics() -> Column:
    """Names of the metrics that a lead row lacks, in their order."""
    lacks = lambda m: F.col(m).isNull() | (F.col(m) == "") if m == "dominant_przeznaczenie" else F.col(m).isNull()
    return F.array_compact(F.array(*(F.when(lacks(m), m) for m in METRICS)))


def lead_quality() -> Column:
    missing = missing_metrics()
    return (
        F.when(F.col("price_zl").isNull() | F.col("price_per_m2_zl").isNull(), "missing_financials")
        .when((price_signal(F.col("price_zl"), F.col("price_per_m2_zl")) == "suspicious") | (F.col("max_coverage_pct") < 15), "review_required")
        .when(F.size(missing) > 0, "partial")
        .otherwise("complete")
    )


def investment_score(signal: Column, quality: Column) -> Column:
    """Points of confidence, coverage, buildable area and price, less penalties; never below zero, half to even."""
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(14,4)")
    coverage = d("max_coverage_pct")
    bonus = F.when(F.col("price_per_m2_zl") > 0, F.greatest(F.lit(0), 30 - F.least(d("price_per_m2_zl") / 25, F.lit(30)))).otherwise(0)
    score = (
        F.least(d("confidence_score"), F.lit(1)) * 35
        + F.least(coverage, F.lit(100)) * F.lit(0.35).cast("decimal(3,2)")
        + F.least(d("max_buildable_area_m2"), F.lit(5000)) / 250
        + bonus
        - F.when(signal == "suspicious", 35).when(signal == "missing", 20).otherwise(0)
        - F.when(quality == "review_required", 20).when(quality == "missing_financials", 25).when(quality == "partial", 10).otherwise(0)
        - F.when((coverage > 0) & (coverage < 30), 12).otherwise(0)
        - F.when((coverage > 0) & (coverage < 15), 18).otherwise(0)
    )
    return F.bround(F.greatest(score, F.lit(0)).cast("decimal(20,8)"), 2).cast("decimal(7,2)")


def cheapness(per_m2: Column, sample: Column, p25: Column, p40: Column) -> Column:
    points = F.when(per_m2.isNull() | (sample == 0), 0).when(per_m2 <= p25, 20).when(per_m2 <= p40, 10).otherwise(0)
    return points.cast("decimal(5,2)")


def retry_category(error: Column, attempts: Column, precinct: Column, number: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(error, F.lit(""))))
    says = lambda *words: _any([low.contains(w) for w in words])
    where, number = F.lower(F.coalesce(precinct, F.lit(""))), F.lower(F.coalesce(number, F.lit("")))
    return (
        F.when((attempts >= 5) | says("manual_review_required", "geometry_missing", "unsupported"), "manual_only_case")
        .when(number.rlike(r"\p{L}") | where.contains("użytkowanie wieczyste") | where.contains("uzytkowanie wieczyste"), "parser_issue")
        .when(says("parse", "extract", "missing parcel", "no parcel number", "raw_teryt"), "parser_issue")
        .when(says("planning source", "no_source", "source_configured"), "missing_planning_source")
        .otherwise("resolver_ambiguity")
    )


def backlog_status(in_registry: Column, has_zones: Column, has_deltas: Column) -> Column:
    unloaded = F.when(in_registry, "source_configured_but_not_loaded").otherwise("no_source_configured")
    covered = F.when(has_deltas, "covered_but_no_buildable_delta").otherwise("covered_but_no_delta")
    return F.when(~has_zones, unloaded).otherwise(covered)


# fixed values: city-district codes that a city-wide plan covers
COVERAGE_ALIAS = {"1261029": "1261011", "1261039": "1261011", "1261049": "1261011", "1261059": "1261011"}


def coverage_alias(code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in COVERAGE_ALIAS.items() for x in kv])
    return F.coalesce(F.element_at(pairs, code), code)


def confidence_band() -> Column:
    """Band of an assessment row: formal, supported, speculative or null; the first rule that holds decides."""
    overall, future, cheap, hits = F.col("overall_score"), F.col("future_signal_score"), F.col("cheapness_score"), F.col("heuristic_hits")
    formal, supporting, corroborated, negative = F.col("has_formal_signal"), F.col("has_supporting_formal_signal"), F.col("has_corroborated_supporting_signal"), F.col("hard_negative")
    return (
        F.when((F.col("current_buildable_status") != "non_buildable") | F.col("dominant_unknown_resolution"), None)
        .when((overall >= 60) & formal, "formal")
        .when((overall >= 60) & supporting & (future >= 40) & ((hits >= 2) | corroborated) & ~negative, "supported")
        .when((overall >= 60) & (hits >= 2) & ~negative, "speculative")
        .when(overall >= 60, None)
        .when((overall >= 55) & (future >= 58) & formal & (hits >= 5) & ~negative, "supported")
        .when((overall >= 30) & (cheap >= 20) & (future >= 10) & supporting & ~negative, "supported")
    )


#: (kind, points, designation, test) of the spatial rules, over the columns of a heuristics row.
def spatial_rules() -> list[tuple[str, int, Column]]:
    near, edge, shared = F.col("distance_to_nearest_buildable_m"), F.col("adjacent_buildable_pct"), F.col("shared_boundary_m")
    return [
        ("heuristic_near_buildable", 10, near <= 50),
        ("heuristic_adjacent_buildable", 10, edge >= 25),
        ("heuristic_shared_boundary", 12, shared >= 8),
        ("heuristic_mixed_service_proximity", 8, F.col("distance_to_mixed_service_zone_m") <= 100),
        ("heuristic_meaningful_road", 6, F.col("distance_to_meaningful_road_m") <= 60),
        ("heuristic_road_access", 5, F.col("has_road_access_signal")),
        ("heuristic_urban_cluster", 10, F.col("has_urban_cluster_signal")),
        ("heuristic_expansion_edge", 8, (shared > 0) & (near <= 25) & F.col("has_urban_cluster_signal")),
    ]


def heuristic_bonus() -> Column:
    out = F.lit(0)
    for _, points, test in spatial_rules():
        out = out + F.when(test, points).otherwise(0)
    return out.cast("decimal(6,2)")


def heuristic_hits() -> Column:
    out = F.lit(0)
    for _, _, test in spatial_rules():
        out = out + F.when(test, 1).otherwise(0)
    return out


def heuristic_breakdown() -> Column:
    return F.array_compact(F.array(*(F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit("heuristic").alias("status"), F.lit(float(points)).alias("weight"))) for kind, points, test in spatial_rules())))
