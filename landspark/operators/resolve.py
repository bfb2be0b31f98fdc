"""Resolution of notices to cadastral parcels: strategies as equi-joins, tie-breaks as staged windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspark.functions.text import PROVINCE_CODES, ascii_key, fold

# fixed values: confidence of each method
CONFIDENCE = {"kw_lookup": 0.92, "teryt_exact": 0.98, "address_fuzzy": 0.55, "uldk_partial": 0.70, "manual": 0.70}
#: An area hint may be off by this share.
TOLERANCE = 0.05


def canonical_id(precinct: Column, number: Column) -> Column:
    """``commune.precinct.number`` of a nine-digit or dotted precinct code; null of anything else."""
    return F.when(precinct.rlike(r"^\d{9}$"), F.concat(F.substring(precinct, 1, 7), F.lit("."), F.lpad(F.substring(precinct, 8, 2), 4, "0"), F.lit("."), number)).when(precinct.rlike(r"^[\d.]*\.[\d.]*$") & precinct.rlike(r"\d"), F.concat(precinct, F.lit("."), number))


def province_code(label: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in PROVINCE_CODES.items() for x in kv])
    return F.try_element_at(pairs, fold(F.trim(label)))


def resolve_by_id(listings: DataFrame, cadastre: DataFrame) -> DataFrame:
    """(listing_id, cad_id, method) of listings whose codes make a canonical id that the cadastre has."""
    keyed = listings.withColumn("cad_id", canonical_id(F.col("raw_obreb"), F.col("raw_numer"))).filter("cad_id IS NOT NULL")
    return keyed.join(cadastre.select("cad_id"), "cad_id").select("listing_id", "cad_id", F.lit("teryt_exact").alias("method"))


def choose(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of the candidates of each key the one that is left, with ``by``: alone (by itself, or in its province) or area.

    ``found``: keys, cad_id, _woj and area_m2 of what is sought, _cad_woj and _cad_area of the candidate.  Without candidates of the
    province all stay; the stages are counts over one window, so candidates are joined once.
    """
    w = Window.partitionBy(*keys)
    rows = found.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_here", F.col("_woj").eqNullSafe(F.col("_cad_woj"))).withColumn("_n_here", F.count_if(F.col("_here")).over(w))
    usable = (F.col("_n_here") == 0) | F.col("_here")
    near = usable & F.col("_cad_area").between(F.col("area_m2") * (1 - TOLERANCE), F.col("area_m2") * (1 + TOLERANCE)) & (F.col("area_m2") > 0)
    rows = rows.withColumn("_near", F.coalesce(near, F.lit(False))).withColumn("_n_near", F.count_if(F.col("_near")).over(w))
    alone = (F.col("_n") == 1) | ((F.col("_n_here") == 1) & F.col("_here"))
    by_area = (F.col("_n") > 1) & (F.col("_n_here") != 1) & (F.col("_n_near") == 1) & F.col("_near")
    return rows.filter(alone | by_area).select(*keys, "cad_id", F.when(alone, "alone").otherwise("area").alias("by"))


def by_precinct(cadastre: DataFrame, name: str = "precinct_name") -> DataFrame:
    """The cadastre as candidates by the key of a precinct's name and a number."""
    return cadastre.select(ascii_key(F.col(name)).alias("_key"), F.col("number").alias("_number"), "cad_id", F.col("woj").alias("_cad_woj"), F.col("area_m2").alias("_cad_area"))


def resolve_by_name(listings: DataFrame, cadastre: DataFrame, name: str = "precinct_name") -> DataFrame:
    """(listing_id, cad_id, method) by precinct name and number, if one candidate is left: alone, by province, then by area."""
    named = listings.filter("raw_obreb IS NOT NULL AND raw_numer IS NOT NULL").select("listing_id", "area_m2", ascii_key(F.col("raw_obreb")).alias("_key"), F.col("raw_numer").alias("_number"), province_code(F.col("raw_woj")).alias("_woj"))
    chosen = choose(named.join(by_precinct(cadastre, name), ["_key", "_number"]), ["listing_id"])
    return chosen.select("listing_id", "cad_id", F.when(F.col("by") == "alone", "teryt_exact").otherwise("uldk_partial").alias("method"))


def resolve_cascade(listings: DataFrame, strategies: list[DataFrame]) -> DataFrame:
    """Every listing with the parcels of the first strategy that has any, its confidence and outcome."""
    out = None
    for k, rows in enumerate(strategies):
        part = rows.withColumn("_k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    first = out.withColumn("_first", F.min("_k").over(Window.partitionBy("listing_id"))).filter("_k = _first").drop("_k", "_first").dropDuplicates(["listing_id", "cad_id"])
    pairs = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return listings.select("listing_id", "raw_obreb", "raw_numer").join(first, "listing_id", "left").select(
        "listing_id",
        "cad_id",
        "method",
        F.element_at(pairs, F.col("method")).cast("decimal(3,2)").alias("match_confidence"),
        F.when(F.col("cad_id").isNotNull(), "resolved").when(F.coalesce("raw_numer", F.lit("")) == "", "missing_parcel_number").when(F.coalesce("raw_obreb", F.lit("")) == "", "missing_precinct").otherwise("not_found_or_ambiguous").alias("outcome"),
    )


def infer_common_region(candidates: DataFrame) -> DataFrame:
    """(notice_id, region_code): the one precinct in which all of a notice's parcels occur, else the strict majority of three or more.

    ``candidates``: notice_id, number, region_code.  Notices of one number have no shared precinct.
    """
    sets = candidates.select("notice_id", "number", "region_code").distinct()
    numbers = sets.groupBy("notice_id").agg(F.countDistinct("number").alias("_numbers")).filter("_numbers > 1")
    votes = sets.groupBy("notice_id", "region_code").agg(F.count(F.lit(1)).alias("votes")).join(numbers, "notice_id")
    top = votes.groupBy("notice_id").agg(F.max("votes").alias("_top"))
    rows = votes.join(top, "notice_id").groupBy("notice_id").agg(
        F.count_if(F.col("votes") == F.col("_numbers")).alias("_common"),
        F.min(F.when(F.col("votes") == F.col("_numbers"), F.col("region_code"))).alias("_one"),
        F.count_if(F.col("votes") == F.col("_top")).alias("_tops"),
        F.min(F.when(F.col("votes") == F.col("_top"), F.col("region_code"))).alias("_best"),
        F.max("_top").alias("_top"),
    )
    code = F.when(F.col("_common") == 1, F.col("_one")).when((F.col("_top") >= 3) & (F.col("_tops") == 1), F.col("_best"))
    return rows.select("notice_id", code.alias("region_code")).filter("region_code IS NOT NULL")
