"""Idempotent table maintenance: each job is a function of the current table and the changes to the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of both by key; where both have a key, the new row's values go before, but for ``keep`` columns that stay.

    A full outer join with null-safe values: a new null doesn't erase a value that is there.
    """
    values = [c for c in current.columns if c not in keys]
    c, n = current.alias("c"), new.alias("n")
    on = [F.col(f"c.{k}") == F.col(f"n.{k}") for k in keys]
    pick = lambda v: F.coalesce(f"c.{v}", f"n.{v}") if v in keep else F.coalesce(f"n.{v}", f"c.{v}")
    return c.join(n, on, "full_outer").select(*(F.coalesce(f"c.{k}", f"n.{k}").alias(k) for k in keys), *(pick(v).alias(v) for v in values))


def insert_absent(current: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``current`` with the batch's rows whose key is not there; of rows of the batch with one key, the first by ``order``."""
    return current.unionByName(newest(batch, keys, order).join(current.select(*keys), keys, "left_anti").select(current.columns))


def listing_hash(url: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(url, F.lit("")), F.coalesce(text, F.lit(""))), 256)


def replace_rows(current: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """``new`` takes the place of all current rows of the scopes that it touches."""
    return current.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def save_deltas(current: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Deltas by (parcel, zone): absent ones are added; with ``force`` the parcels' rows are replaced."""
    return replace_rows(current, new, ["parcel_id"]) if force else current.unionByName(new.join(current, ["parcel_id", "zone_id"], "left_anti").select(current.columns))


def upsert_leads(current: DataFrame, new: DataFrame) -> DataFrame:
    """Leads by (parcel, strategy): new ones are added; a higher score replaces score and priority and appends its evidence; the price is always refreshed.

    Rounded scores are compared with rounded ones, so a rerun changes nothing.
    """
    c, n = current.alias("c"), new.alias("n")
    keys = ["parcel_id", "strategy_type"]
    raised = F.col("c.parcel_id").isNull() | (F.col("n.confidence_score") > F.col("c.confidence_score"))
    pick = lambda v: F.when(raised, F.coalesce(f"n.{v}", f"c.{v}")).otherwise(F.col(f"c.{v}")).alias(v)
    none = F.array().cast(current.schema["evidence"].dataType)
    evidence = F.concat(F.coalesce("c.evidence", none), F.when(raised, F.coalesce("n.evidence", none)).otherwise(none))
    return c.join(n, [F.col(f"c.{k}") == F.col(f"n.{k}") for k in keys], "full_outer").select(
        *(F.coalesce(f"c.{k}", f"n.{k}").alias(k) for k in keys), pick("confidence_score"), pick("priority"), F.coalesce("n.price_per_m2_zl", "c.price_per_m2_zl").alias("price_per_m2_zl"), evidence.alias("evidence")
    )


#: Hours to the next attempt after the first, second, third and fourth failure.
BACKOFF = (1, 4, 24, 72)


def update_retry_queue(current: DataFrame, failures: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """Failures counted up to ``most``; the next attempt after 1, 4, 24 or 72 hours, and never after that or without a geometry."""
    c, f = current.alias("c"), failures.alias("f")
    attempts = F.least(F.coalesce("c.attempt_count", F.lit(0)) + F.when(F.col("f.listing_id").isNotNull(), 1).otherwise(0), F.lit(most)).cast("int")
    joined = c.join(f, F.col("c.listing_id") == F.col("f.listing_id"), "full_outer").select(
        F.coalesce("c.listing_id", "f.listing_id").alias("listing_id"), attempts.alias("attempt_count"), F.coalesce("f.last_error", "c.last_error").alias("last_error"), F.col("f.listing_id").isNotNull().alias("_failed"), F.col("c.next_retry_at").alias("_old")
    )
    hours = F.element_at(F.array(*map(F.lit, BACKOFF)), F.least("attempt_count", F.lit(len(BACKOFF))))
    never = (F.col("attempt_count") >= most) | F.upper("last_error").contains("GEOMETRY_MISSING")
    due = F.when(never, F.to_timestamp(F.lit("9999-12-31 00:00:00"))).otherwise(F.timestamp_seconds(F.unix_timestamp(now) + hours * 3600))
    return joined.select("listing_id", "attempt_count", "last_error", F.when(F.col("_failed"), due).otherwise(F.col("_old")).alias("next_retry_at"))


def mark_processed(listings: DataFrame, ids: DataFrame, key: str = "listing_id") -> DataFrame:
    done = ids.select(key).distinct().withColumn("_done", F.lit(True))
    return listings.join(done, key, "left").withColumn("is_processed", F.coalesce("_done", F.col("is_processed"))).drop("_done")


def pending_listings(listings: DataFrame, limit: int, ids: DataFrame | None = None) -> DataFrame:
    """Unprocessed listings, oldest first."""
    out = listings.filter("NOT is_processed")
    out = out if ids is None else out.join(ids, "listing_id", "left_semi")
    return out.orderBy("created_at", "listing_id").limit(limit)


def backfill_current_use(parcels: DataFrame, updates: DataFrame, overwrite: bool = False) -> DataFrame:
    """``current_use`` from the updates, in blank places or, with ``overwrite``, everywhere."""
    u = updates.select("parcel_id", F.col("current_use").alias("_new"))
    blank = F.trim(F.coalesce("current_use", F.lit(""))) == ""
    return parcels.join(u, "parcel_id", "left").withColumn("current_use", F.when(F.col("_new").isNotNull() & (blank | F.lit(overwrite)), F.col("_new")).otherwise(F.col("current_use"))).drop("_new")


def update_status(leads: DataFrame, changes: DataFrame, now: Column, allowed=("new", "reviewed", "shortlisted", "rejected")) -> DataFrame:
    """Workflow changes that name an allowed state; others leave the lead as it is."""
    ch = changes.filter(F.col("status").isin(*allowed)).select("lead_id", F.col("status").alias("_s"))
    return leads.join(ch, "lead_id", "left").withColumn("reviewed_at", F.when(F.col("_s").isNotNull(), now)).withColumn("status", F.coalesce("_s", "status")).drop("_s")


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of each rule in one pass: rule, n_rows, n_violations; a null test counts as a violation."""
    broken = [F.sum(F.when(F.coalesce(test, F.lit(False)), 0).otherwise(1)).alias(name) for name, test in rules.items()]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *broken)
    return one.select("_rows", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("n_violations")) for n in rules))).alias("r")).select("r.rule", F.col("_rows").alias("n_rows"), "r.n_violations")


def collapse_second_auctions(listings: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated auctions as one listing: the first one's id, the latest one's price and date."""
    return listings.groupBy(*keys).agg(F.min_by("listing_id", F.struct("created_at", "listing_id")).alias("listing_id"), F.max_by("price_zl", F.struct("created_at", "listing_id")).alias("price_zl"), F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("n_auctions"))


def infer_use(url: Column) -> Column:
    """Land use that a listing's address hints at."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(low.contains("-las"), "Ls").when(low.contains("-roln"), "R").when(low.contains("-budowlan"), "Bp")


def derive_codes(df: DataFrame, code: str = "teryt_gmina") -> DataFrame:
    """Province, county, commune parts of a code and the canonical parcel id."""
    c = F.col(code)
    return df.withColumn("woj", F.substring(c, 1, 2)).withColumn("powiat", F.substring(c, 1, 4)).withColumn("canonical_id", F.concat(F.substring(c, 1, 6), F.lit("_"), F.substring(c, 7, 1), F.lit("."), F.lpad((F.col("parcel_id") % 30 + 1).cast("string"), 4, "0"), F.lit("."), F.col("numer")))
