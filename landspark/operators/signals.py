"""Planning signals: attaching them to parcels, scoring, corroboration, market benchmarks and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspark.functions import planning as p
from landspark.operators.sizes import small


def attach_signals(parcels: DataFrame, signals: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """(parcel_id, signal columns): signals bound to the parcel, of its (aliased) commune without a parcel, or whose polygon overlaps it.

    The three ways are three equi-joins; a signal that comes by two of them counts once.
    """
    keyed = parcels.select("parcel_id", p.coverage_alias(F.col("teryt_gmina")).alias("_g"))
    s = signals.withColumn("_g", p.coverage_alias(F.col("teryt_gmina"))).drop("teryt_gmina")
    bound = s.filter("parcel_id IS NOT NULL").join(keyed.select("parcel_id", "_g"), ["parcel_id", "_g"])
    level = s.filter("parcel_id IS NULL").drop("parcel_id").join(keyed, "_g")
    out = bound.unionByName(level)
    if overlaps is not None:
        out = out.unionByName(s.drop("parcel_id").join(overlaps.select("parcel_id", "signal_id"), "signal_id").select(out.columns))
    return out.drop("_g").dropDuplicates(["parcel_id", "signal_id"])


def weighed(signals: DataFrame) -> DataFrame:
    kind, designation, status = F.col("signal_kind"), F.col("designation_normalized"), F.col("signal_status")
    return signals.withColumn("weight", p.signal_weight(kind, designation, status)).withColumn("label", p.signal_label(kind, designation, F.col("plan_name")))


def _sides(parcels: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parcels (parcel_id, _g), the signals bound to them, and the signals of whole (aliased) communes."""
    keyed = parcels.select("parcel_id", p.coverage_alias(F.col("teryt_gmina")).alias("_g"))
    s = signals.withColumn("_g", p.coverage_alias(F.col("teryt_gmina"))).drop("teryt_gmina").dropDuplicates(["signal_id"])
    return keyed, s.filter("parcel_id IS NOT NULL").join(keyed, ["parcel_id", "_g"]), s.filter("parcel_id IS NULL").drop("parcel_id")


def _both(keyed: DataFrame, own: DataFrame, level: DataFrame) -> DataFrame:
    """parcel_id with ``o``, its own aggregates, and ``l``, its commune's: one row a parcel, if it has either."""
    struct = lambda df, key, name: df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name))
    rows = keyed.join(small(struct(level, "_g", "l")), "_g", "left").join(struct(own, "parcel_id", "o"), "parcel_id", "left")
    return rows.filter(F.col("o").isNotNull() | F.col("l").isNotNull())


def _plus(c: str) -> Column:
    return F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"l.{c}"), F.lit(0))


def count_signals(parcels: DataFrame, signals: DataFrame) -> DataFrame:
    """Number and summed ids of each parcel's signals, its own ones and its commune's; the latter are summed once a commune."""
    keyed, bound, level = _sides(parcels, signals)
    total = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("signal_id").alias("s"))
    return _both(keyed, total(bound, "parcel_id"), total(level, "_g")).select("parcel_id", _plus("n").alias("n"), _plus("s").alias("s"))


def score_signals(parcels: DataFrame, signals: DataFrame) -> DataFrame:
    """Signal score, positive count, flags and dominant label of each parcel's own signals and its commune's.

    Communes' signals are scored once a commune, so no parcel meets them one by one.
    """
    keyed, bound, level = _sides(parcels, signals)
    positive, negative = F.col("weight") > 0, (F.col("weight") < 0) & F.col("designation_normalized").isin(*p.HARD_NEGATIVE)
    flag = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    total = lambda df, key: weighed(df).groupBy(key).agg(
        F.sum("weight").alias("score"),
        F.count_if(positive).alias("positive"),
        flag(F.col("signal_kind").isin("pog_zone", "pog_ouz", "studium_zone") & positive).alias("formal"),
        flag(F.col("signal_kind").isin("planning_resolution", "mpzp_project") & positive).alias("supporting"),
        flag(negative).alias("negative"),
        F.min(F.when(positive, F.struct((-F.col("weight")).alias("w"), "signal_id", "label"))).alias("top"),
    )
    either = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(False)) | F.coalesce(F.col(f"l.{c}"), F.lit(False))
    return _both(keyed, total(bound, "parcel_id"), total(level, "_g")).select(
        "parcel_id",
        _plus("score").cast("decimal(16,2)").alias("signal_score"),
        _plus("positive").alias("positive_signals"),
        either("formal").alias("has_formal_signal"),
        either("supporting").alias("has_supporting_formal_signal"),
        either("negative").alias("hard_negative"),
        F.least("o.top", "l.top")["label"].alias("dominant_signal"),
    )


def corroborate(parcels: DataFrame, signals: DataFrame, least: int = 3) -> DataFrame:
    """Parcels with at least ``least`` distinct supporting sources of one positive class, else of all: class and number.

    Communes' sources are counted once a commune; of a parcel's own ones only those count that its commune has not.
    """
    key = F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("plan_name", F.lit("")), F.col("signal_id").cast("string"))

    def sources(df: DataFrame, *keys: str) -> DataFrame:
        rows = weighed(df).filter(F.col("signal_kind").isin("planning_resolution", "mpzp_project") & F.col("designation_normalized").isin(*p.POSITIVE) & (F.col("weight") > 0))
        return rows.select(*keys, F.col("designation_normalized").alias("d"), key.alias("s")).distinct()

    def counts(df: DataFrame, by: str, classes: DataFrame) -> DataFrame:
        """Sources of each class, and ``family``, those of all classes, by parcel or commune."""
        some = df.groupBy(by).agg(*(F.count_if(F.col("d") == c).alias(c) for c in p.POSITIVE))
        return some.join(classes.groupBy(by).agg(F.count(F.lit(1)).alias("family")), by, "full_outer")

    keyed, bound, level = _sides(parcels, signals)
    own, theirs = sources(bound, "parcel_id", "_g"), sources(level, "_g")
    all_own, all_theirs = own.select("parcel_id", "_g", "s").distinct(), theirs.select("_g", "s").distinct()
    more, all_more = own.join(theirs, ["_g", "d", "s"], "left_anti"), all_own.join(all_theirs, ["_g", "s"], "left_anti")
    rows = _both(keyed, counts(more, "parcel_id", all_more), counts(theirs, "_g", all_theirs)).select("parcel_id", _plus("family").alias("n"), *(_plus(c).alias(c) for c in p.POSITIVE))
    best = F.least(*(F.when(F.col(c) >= least, F.struct((-F.col(c)).alias("k"), F.lit(c).alias("c"))) for c in p.POSITIVE))
    return rows.filter(F.col("n") >= least).withColumn("b", best).select("parcel_id", F.coalesce("b.c", F.lit("urbanizable")).alias("designation"), F.coalesce(-F.col("b.k"), F.col("n")).alias("n_sources"), F.lit(10).alias("bonus"))


def market_benchmark(prices: DataFrame) -> DataFrame:
    """Count, p25, p40 and median of price per m² of every commune, county and province, in one pass of grouping sets.

    ``prices``: teryt_gmina and price_per_m2.  Result: scope, code, sample_size, p25, p40, median.
    """
    rows = prices.filter("price_per_m2 IS NOT NULL").select("teryt_gmina", F.substring("teryt_gmina", 1, 4).alias("powiat"), F.substring("teryt_gmina", 1, 2).alias("woj"), "price_per_m2")
    out = rows.groupingSets([["teryt_gmina"], ["powiat"], ["woj"]], "teryt_gmina", "powiat", "woj").agg(
        F.count(F.lit(1)).alias("sample_size"), F.percentile("price_per_m2", F.array(F.lit(0.25), F.lit(0.4), F.lit(0.5))).alias("_q")
    )
    scope = F.when(F.col("teryt_gmina").isNotNull(), "gmina").when(F.col("powiat").isNotNull(), "powiat").otherwise("wojewodztwo")
    return out.select(scope.alias("scope"), F.coalesce("teryt_gmina", "powiat", "woj").alias("code"), "sample_size", *(F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(("p25", "p40", "median"))))


def with_benchmark(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each row's benchmark: its commune's, else its county's, else its province's."""
    out = rows
    for scope, width in (("gmina", 7), ("powiat", 4), ("wojewodztwo", 2)):
        part = benchmark.filter(F.col("scope") == scope).select(F.col("code").alias("_code"), F.struct("scope", "sample_size", "p25", "p40", "median").alias(f"_{scope}"))
        out = out.join(part, F.substring("teryt_gmina", 1, width) == F.col("_code"), "left").drop("_code")
    return out.withColumn("_b", F.coalesce("_gmina", "_powiat", "_wojewodztwo")).select(*rows.columns, *(F.col(f"_b.{c}").alias(c) for c in ("scope", "sample_size", "p25", "p40", "median")))


def benchmark_delta(price: Column, sample: Column, p25: Column, p40: Column, median: Column) -> Column:
    """Per cent under (positive) or over the median; null where the benchmark is not reliable."""
    return F.when((sample >= 5) & p25.isNotNull() & p40.isNotNull() & (median > 0), F.round((median - price) / median * 100, 2))


def signal_mix(signals: DataFrame, by: str = "teryt_gmina") -> DataFrame:
    d = F.coalesce(F.nullif("designation_normalized", F.lit("")), F.lit("unknown"))
    return signals.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(d.isin(*p.POSITIVE)).alias("positive"), F.count_if(d == "unknown").alias("unknown"), F.count_if(d.isin(*p.HARD_NEGATIVE)).alias("hard_negative"))


def freshness(df: DataFrame, by: str, stamp: str, now: Column) -> DataFrame:
    """Rows, newest stamp and its age in whole hours of each group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(stamp).alias("newest")).withColumn("age_hours", F.floor((F.unix_timestamp(now) - F.unix_timestamp("newest")) / 3600))


def known_sources(signals: DataFrame) -> DataFrame:
    """Ordered distinct sources of each commune as one string, and the last sync."""
    return signals.groupBy("teryt_gmina").agg(F.array_join(F.array_sort(F.collect_set("source_type")), ", ").alias("sources"), F.max("created_at").alias("last_sync"))


def coverage_target(parcels: DataFrame, zones: DataFrame, leads: DataFrame, pct: float = 70.0) -> DataFrame:
    """By province: communes with parcels, with zones and with leads, the share covered, and the gap to the target."""
    communes = lambda df, name: df.select(F.col("teryt_gmina").alias("g")).distinct().withColumn(name, F.lit(1))
    joined = communes(parcels, "has_parcels").join(communes(zones, "has_zones"), "g", "left").join(communes(leads, "has_leads"), "g", "left")
    out = joined.groupBy(F.substring("g", 1, 2).alias("province")).agg(F.count(F.lit(1)).alias("n_gminas"), F.count("has_zones").alias("covered"), F.count("has_leads").alias("with_leads"))
    target = F.ceil(F.col("n_gminas") * pct / 100).cast("long")
    return out.withColumn("coverage_pct", F.round(100.0 * F.col("covered") / F.col("n_gminas"), 1)).withColumn("target", target).withColumn("gap", F.greatest(target - F.col("covered"), F.lit(0)))


def calibrate(corpus: DataFrame, assessments: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision and recall of ``overall_score >= threshold`` against the labels; each row is counted at every threshold it passes."""
    rows = corpus.join(assessments, "parcel_id").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit, true = F.col("overall_score") >= F.col("threshold"), F.col("label") == "positive"
    out = rows.groupBy("threshold").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    return out.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))
