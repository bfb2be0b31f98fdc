"""Operations reports, source advice, collections of polygons, colours and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.functions import planning as p
from landspark.operators.sizes import small

FORMAL_KINDS = ("pog_zone", "pog_ouz", "studium_zone")
SUPPORTING_KINDS = ("planning_resolution", "mpzp_project")
#: Entries of a legend at most.
LEGEND = 2000


def signal_tier(strategy: Column, band: Column, breakdown: Column) -> Column:
    """Quality tier of a future lead from its band and its signals (an array of structs kind, designation_normalized, weight)."""
    positive = F.exists(breakdown, lambda s: s["weight"] > 0)
    blocked = F.exists(breakdown, lambda s: (s["weight"] < 0) & s["designation_normalized"].isin(*p.HARD_NEGATIVE))
    return F.when(strategy != "future_buildable", None).when(band == "formal", "formal").when(band == "supported", "supported").when((band == "speculative") | positive, "below_threshold").when(blocked, "blocked").otherwise("below_threshold")


# fixed values: the operator's next steps
ACTIONS = {
    "formal": "Shortlist and verify access, price, and source docs.",
    "supported": "Confirm the planning source and validate the parcel boundary.",
    "negative": "Skip or re-scope this parcel; hard-negative planning signals dominate.",
    "geometry": "Look for geometry-backed POG/Studium coverage to lift it above threshold.",
    "dominant": "Add stronger heuristics or a formal planning source to lift the dominant signal.",
    "research": "Research missing planning coverage or find a better planning source.",
}


def next_action(strategy: Column, band: Column, breakdown: Column, dominant: Column) -> Column:
    tier = signal_tier(strategy, band, breakdown)
    of = lambda kinds: F.exists(breakdown, lambda s: s["kind"].isin(*kinds) & (s["weight"] > 0))
    positive = F.exists(breakdown, lambda s: s["weight"] > 0)
    blocked = F.exists(breakdown, lambda s: (s["weight"] < 0) & s["designation_normalized"].isin(*p.HARD_NEGATIVE))
    return (
        F.when(strategy != "future_buildable", None)
        .when(tier == "formal", ACTIONS["formal"])
        .when(tier == "supported", ACTIONS["supported"])
        .when(blocked & ~positive, ACTIONS["negative"])
        .when(of(SUPPORTING_KINDS) & ~of(FORMAL_KINDS), ACTIONS["geometry"])
        .when(F.coalesce(dominant, F.lit("")) != "", ACTIONS["dominant"])
        .otherwise(ACTIONS["research"])
    )


def sum_polygons(df: DataFrame, by: list[str]) -> DataFrame:
    """Number and summed area of each group's polygons with disjoint interiors; no row holds the group's geometry."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_parts"), F.round(F.sum(g.area(F.col("geom"))), 2).alias("area"))


def collect_polygons(df: DataFrame, by: list[str], key: str, most: int = 1000) -> DataFrame:
    """Multipolygons of each group of polygons with disjoint interiors, ``part`` by ``part``; about ``most`` polygons each at most.

    A group gets as many parts as its number of polygons asks for, dealt by the hash of ``key``.
    """
    parts = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).alias("_k"))
    rows = df.join(small(parts), by).withColumn("part", F.pmod(F.xxhash64(key), F.col("_k")))
    return rows.groupBy(*by, "part").agg(F.flatten(F.collect_list("geom")).alias("geom"), F.count(F.lit(1)).alias("n_parts"))


def dedup_tiled(zones: DataFrame, order: list[Column]) -> DataFrame:
    """Zones that several tiles brought, once: of those with one centroid in whole metres and one symbol, the first."""
    w = Window.partitionBy(g.geom_hash(F.col("geom")), "symbol").orderBy(*order)
    return zones.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def classify_colours(samples: DataFrame, legend: DataFrame) -> DataFrame:
    """Nearest legend colour of each sample (id, r, g, b, hint): entries whose designation is the hint go before those whose label holds it, these before all.

    The legend is a short list, of at most ``LEGEND`` entries or an error; it is broadcast as one row, and each sample keeps one entry by
    one aggregation.
    """
    if legend.limit(LEGEND + 1).count() > LEGEND:
        raise ValueError(f"a legend has at most {LEGEND} entries; classify the pictures of one legend at a time")
    gap = lambda c: (F.col(c) - F.col(f"l_{c}")) * (F.col(c) - F.col(f"l_{c}"))
    named = legend.select("designation", "label", *(F.col(c).alias(f"l_{c}") for c in "rgb"))
    tier = F.when(F.col("hint") == F.col("designation"), 0).when(F.lower("label").contains(F.lower("hint")), 1).otherwise(2)
    entries = named.agg(F.collect_list(F.struct(*named.columns)).alias("legend"))
    rows = samples.join(F.broadcast(entries)).withColumn("_e", F.explode("legend")).select(*samples.columns, "_e.*")
    d = F.sqrt((gap("r") + gap("g") + gap("b")).cast("double"))
    best = rows.groupBy("id").agg(F.min(F.struct(F.coalesce(tier, F.lit(2)).alias("tier"), d.alias("d"), F.col("designation"))).alias("b"))
    return best.select("id", F.col("b.designation").alias("designation"), F.round(1 - F.col("b.d") / F.sqrt(F.lit(3.0 * 255 * 255)), 4).alias("confidence"))


def dominant_colour(pixels: DataFrame, by: str) -> DataFrame:
    """Most frequent colour of each group without near-white and near-black greys, unless there is nothing else; ties to the more colourful, then brighter."""
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    counts = pixels.groupBy(by, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    grey = (hi - lo <= 12) & ((hi >= 245) | (hi <= 30))
    key = F.struct((~grey).alias("usable"), "n", (hi - lo).alias("chroma"), (F.col("r") + F.col("g") + F.col("b")).alias("light"), "r", "g", "b")
    return counts.groupBy(by).agg(F.max(key).alias("_top")).select(by, *(F.col(f"_top.{c}").alias(c) for c in ("r", "g", "b", "n")))


def run_ledger(events: DataFrame) -> DataFrame:
    """Runs closed by their events: failed if nothing was saved and something failed, partial if something failed, else completed."""
    done = events.groupBy("run_id").agg(F.count_if(F.col("ok")).alias("saved"), F.count_if(~F.col("ok")).alias("failed"), F.min("at").alias("started"), F.max("at").alias("ended"))
    return done.withColumn("status", F.when((F.col("failed") > 0) & (F.col("saved") == 0), "failed").when(F.col("failed") > 0, "partial").otherwise("completed"))


def load_current_use(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed land uses: the rows that may be used, and those rejected, with a reason (empty or repeated id, characters)."""
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("identyfikator")))
    reason = F.when(F.coalesce(F.trim("identyfikator"), F.lit("")) == "", "empty_id").when(F.col("_n") > 1, "repeated_id").when(~F.coalesce(F.col("current_use"), F.lit("")).rlike(r"^[\p{L}]{1,4}$"), "bad_code")
    marked = counted.withColumn("reason", reason).drop("_n")
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def coverage_category(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Category of uncovered communes: an override, else by whether a source is configured."""
    return rows.join(overrides.select("teryt_gmina", F.col("category").alias("_o")), "teryt_gmina", "left").withColumn("category", F.coalesce("_o", F.when(F.col("in_registry"), "source_configured").otherwise("no_source"))).drop("_o")


def suggest_label(score: Column, negative: Column, band: Column) -> Column:
    return F.when(negative, "negative").when(band.isin("formal", "supported") | (score >= 60), "positive").when(score < 20, "negative").otherwise("uncertain")


def refresh_signals(current: DataFrame, fresh: DataFrame, managed: list[str], commune: str | None = None) -> DataFrame:
    """Rows of managed source types (of one commune, if given) give way to fresh ones; the others stay."""
    gone = F.col("source_type").isin(*managed)
    if commune is not None:
        gone, fresh = gone & (F.col("teryt_gmina") == commune), fresh.filter(F.col("teryt_gmina") == commune)
    return current.filter(~F.coalesce(gone, F.lit(False))).unionByName(fresh)


def sweep_retry(queue: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue without rows whose listing is resolved or whose case is manual, and the manual rows for the backlog."""
    category = p.retry_category(F.col("last_error"), F.col("attempt_count"), F.col("raw_obreb"), F.col("raw_numer_dzialki"))
    # bare ids are many in few compressed bytes, by which they would be broadcast
    left = queue.join(links.select("listing_id").hint("merge"), "listing_id", "left_anti").withColumn("category", category)
    return left.filter("category <> 'manual_only_case'"), left.filter("category = 'manual_only_case'")


def scope_parcels(parcels: DataFrame, ids: list[int] = (), communes: list[str] = (), provinces: list[str] = ()) -> DataFrame:
    """Parcels named by id, commune or province; all if nothing is named."""
    if not (ids or communes or provinces):
        return parcels
    return parcels.filter(F.col("parcel_id").isin(*ids) | F.col("teryt_gmina").isin(*communes) | F.substring("teryt_gmina", 1, 2).isin(*provinces)).dropDuplicates(["parcel_id"])
