"""Lead views: search, sorting, watchlists, sections and the investor's snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspark.functions import planning as p

RELIABLE = "reliable"


def with_rules(leads: DataFrame) -> DataFrame:
    """Price signal, missing metrics, quality and investment score of lead rows; a future lead's overall score goes before."""
    out = leads.withColumn("price_signal", p.price_signal(F.col("price_zl"), F.col("price_per_m2_zl"))).withColumn("missing", p.missing_metrics()).withColumn("quality", p.lead_quality())
    score = p.investment_score(F.col("price_signal"), F.col("quality"))
    return out.withColumn("investment_score", F.when((F.col("strategy_type") == "future_buildable") & F.col("overall_score").isNotNull(), F.col("overall_score").cast("decimal(7,2)")).otherwise(score))


#: Search parameters that compare one column, with the comparison.
COMPARISONS = {
    "min_score": lambda v: F.col("confidence_score") >= v,
    "strategy": lambda v: F.coalesce("strategy_type", F.lit("current_buildable")) == v,
    "confidence_band": lambda v: F.col("confidence_band") == v,
    "min_price_zl": lambda v: F.col("price_zl") >= v,
    "max_price_zl": lambda v: F.col("price_zl") <= v,
    "min_price_per_m2_zl": lambda v: F.col("price_per_m2_zl") >= v,
    "max_price_per_m2_zl": lambda v: F.col("price_per_m2_zl") <= v,
    "min_area_m2": lambda v: F.col("area_m2") >= v,
    "max_area_m2": lambda v: F.col("area_m2") <= v,
    "min_coverage_pct": lambda v: F.col("max_coverage_pct") >= v,
    "min_buildable_area_m2": lambda v: F.col("area_m2") * F.coalesce("max_coverage_pct", F.lit(0)) / 100 >= v,
    "teryt_prefix": lambda v: F.col("teryt_gmina").startswith(v),
    "teryt_gmina": lambda v: F.col("teryt_gmina") == v,
    "designation": lambda v: _says(v, "dominant_przeznaczenie", "dominant_future_signal"),
    "search": lambda v: _says(v, "identyfikator", "source_url", "dominant_future_signal", "notes"),
}


def _says(text: str, *columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return out


def matching(view: DataFrame, status: str | None = None, cheap_only: bool = False, **filters) -> DataFrame:
    """The rows of a lead view that pass; only the filters that are given reach the plan.  Rejected leads need ``status='rejected'``."""
    out = view.filter(F.col("status") == status) if status else view.filter("status <> 'rejected'")
    if cheap_only:
        current = F.coalesce("strategy_type", F.lit("current_buildable")) == "current_buildable"
        out = out.filter((F.coalesce("cheapness_score", F.lit(0)) > 0) | (current & F.col("price_per_m2_zl").isNotNull()))
    for name, value in filters.items():
        if value is not None:
            out = out.filter(COMPARISONS[name](value))
    return out


def search_leads(view: DataFrame, limit: int = 100, **filters) -> DataFrame:
    """The best ``limit`` (1 to 500) matching leads by score, then newest, then id."""
    return matching(view, **filters).orderBy(F.desc("confidence_score"), F.desc("created_at"), "lead_id").limit(max(1, min(500, limit)))


def count_leads(view: DataFrame, **filters) -> DataFrame:
    return matching(view, **filters).agg(F.count(F.lit(1)).alias("n"))


_reliable_first = lambda: F.desc(F.col("price_signal") == RELIABLE)
_down = lambda c: F.col(c).desc_nulls_last()
_up = lambda c: F.col(c).asc_nulls_last()
SORTS = {
    "investment_score_desc": lambda: [_down("investment_score")],
    "price_per_m2_asc": lambda: [_reliable_first(), _up("price_per_m2_zl")],
    "total_price_asc": lambda: [_reliable_first(), _up("price_zl")],
    "total_price_desc": lambda: [_reliable_first(), _down("price_zl")],
    "entry_price_asc": lambda: [_reliable_first(), _up("price_zl")],
    "area_desc": lambda: [_down("area_m2"), _up("price_per_m2_zl")],
    "buildable_area_desc": lambda: [_down("max_buildable_area_m2"), _down("max_coverage_pct")],
    "confidence_desc": lambda: [],
}


def sort_keys(key: str) -> list[Column]:
    """Order of a sort mode, ending in confidence, coverage and id."""
    return [*SORTS[key](), F.desc("confidence_score"), _down("max_coverage_pct"), F.asc("lead_id")]


def sort_leads(view: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    out = view.orderBy(*sort_keys(key))
    return out if limit is None else out.limit(limit)


def filter_view(view: DataFrame, strategy: str, band: str = "all") -> DataFrame:
    """The default future view hides speculative leads."""
    if strategy == "future_buildable" and band == "all":
        return view.filter(~((F.col("strategy_type") == "future_buildable") & F.col("confidence_band").eqNullSafe("speculative")))
    return view


def investor_snapshot(view: DataFrame) -> DataFrame:
    """Fourteen measures of a lead view in one aggregation."""
    future, reliable = F.col("strategy_type") == "future_buildable", F.col("price_signal") == RELIABLE
    per_m2 = F.when(reliable, F.col("price_per_m2_zl"))
    band = lambda b: F.count_if(future & (F.col("confidence_band") == b))
    return view.agg(
        F.count(F.lit(1)).alias("visible"),
        F.count_if(F.col("strategy_type") == "current_buildable").alias("current_buildable"),
        F.count_if(future).alias("future_buildable"),
        band("formal").alias("future_formal"),
        band("supported").alias("future_supported"),
        band("speculative").alias("future_speculative"),
        F.count("price_per_m2_zl").alias("with_price"),
        F.count_if(reliable).alias("reliable_price"),
        F.count_if(F.col("confidence_score") >= 0.9).alias("prime"),
        F.min(per_m2).alias("best_price_per_m2"),
        F.percentile(per_m2, 0.5).alias("median_price_per_m2"),
        F.percentile(F.when(future, F.col("cheapness_score")), 0.5).alias("median_cheapness"),
        F.min(F.when(reliable, F.col("price_zl"))).alias("cheapest_entry"),
        F.round(F.avg("max_coverage_pct"), 4).alias("average_coverage_pct"),
    )


def lead_sections(view: DataFrame) -> DataFrame:
    """Leads by strategy with counts by band."""
    band = lambda b: F.count_if(F.col("confidence_band") == b).alias(f"n_{b}")
    return view.groupBy("strategy_type").agg(F.count(F.lit(1)).alias("n"), band("formal"), band("supported"), band("speculative"))


def watchlist_match(view: DataFrame, mode: str = "standard", min_confidence_pct: float = 0, min_coverage_pct: float = 0, only_reliable: bool = False, max_price_per_m2: float | None = None, designation: str = "") -> DataFrame:
    """Leads that meet a watchlist's criteria; in the future mode the overall score stands for confidence and coverage."""
    by_confidence = F.col("confidence_score") * 100
    if mode == "future_buildable":
        score = F.coalesce("overall_score", by_confidence)
        out = view.filter((F.col("strategy_type") == "future_buildable") & (score >= min_confidence_pct) & (score >= min_coverage_pct))
        label = F.coalesce("dominant_future_signal", "dominant_przeznaczenie")
    else:
        out = view.filter((by_confidence >= min_confidence_pct) & (F.coalesce("max_coverage_pct", F.lit(0)) >= min_coverage_pct))
        label = F.col("dominant_przeznaczenie")
    if only_reliable:
        out = out.filter(F.col("price_signal") == RELIABLE)
    if max_price_per_m2 is not None:
        out = out.filter(F.col("price_per_m2_zl") <= max_price_per_m2)
    wanted = designation.strip().upper()
    return out.filter(F.upper(F.trim(F.coalesce(label, F.lit("")))).contains(wanted)) if wanted else out


def new_matches(matches: DataFrame, acknowledged: Column | None) -> DataFrame:
    return matches if acknowledged is None else matches.filter(F.col("created_at") > acknowledged)


def source_status(auction: Column, today: Column) -> Column:
    return F.when(auction.isNull(), "unknown").when(auction < today, "expired").otherwise("live")


def dedupe_leads(leads: DataFrame) -> DataFrame:
    """The newest lead of each parcel and strategy."""
    w = Window.partitionBy("parcel_id", "strategy_type").orderBy(F.desc("created_at"), F.desc("lead_id"))
    return leads.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_by(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of each key the row with the greatest ``order``, by one aggregation without a sort."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("_top")).select(key, *(F.col(f"_top.{c}").alias(c) for c in columns))


def balanced_pick(df: DataFrame, group: str, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """``n`` rows taken in turns from the groups, in their order; what one group lacks the others fill."""
    rank = F.array_position(F.array(*map(F.lit, groups)), F.col(group))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.filter(F.col(group).isin(*groups)).withColumn("turn", turn).filter(F.col("turn") <= n).withColumn("group_rank", rank).orderBy("turn", "group_rank").limit(n)


def extend_pick(picked: DataFrame, pool: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """``picked`` and, where it has fewer than ``n`` rows, the first of ``pool`` that are not among them."""
    rest = pool.join(picked.select(key), key, "left_anti").orderBy(*order).limit(n).withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    return picked.withColumn("_p", F.lit(0)).withColumn("_r", F.lit(0)).unionByName(rest.withColumn("_p", F.lit(1)), allowMissingColumns=True).orderBy("_p", "_r", key).limit(n).drop("_p", "_r")


def top_by(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
