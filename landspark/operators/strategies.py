"""Further strategies of resolving listings to cadastral parcels, and the cascade of all of them.

Every strategy is an equi-join of keys with the cadastre or a register, then a choice among the candidates of a key by counts over
windows.  None searches a text with the names of a table: texts are cut into runs of words, and runs are joined.

Listings: listing_id, raw_obreb, raw_numer, raw_woj, raw_gmina, raw_kw, area_m2, raw_text, title; listing_id is unique.  The
cadastre: cad_id, commune, region_code, region_name, number, woj, area_m2; cad_id is unique.  Notices: listing_id, numbers (array), text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspark.functions import places as p
from landspark.functions.text import ascii_key, nominative
from landspark.operators.places import HINTS
from landspark.operators.resolve import CONFIDENCE, by_precinct, choose, province_code, resolve_by_id, resolve_by_name, resolve_cascade
from landspark.operators.sizes import small, spread
from landspark.storage import keep

# fixed values: what ends the description of a property, and the province whose registers are asked
OFFICES = ("Komornik Sądowy", "Kancelaria Komornicza", "Komornik przy")
REGISTERED = "12"
ADDRESS = next(h for h in HINTS if h[0] == "address_locality")
REGION = p.any_of("obreb", "obrebie", "obrebu", "obr.", "ob.") + rf"\s*(?:{p.any_of('nr.')})?\s*"


def precinct_of(raw: Column) -> Column:
    """The name in a raw precinct in the nominative; null of a bare code."""
    name = F.regexp_replace(F.trim(raw), r"^\d{4}\s+", "")
    return F.when(~name.rlike(r"^\d*$"), nominative(name))


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_key(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def runs_of(words: Column, longest: int) -> Column:
    """All runs of up to ``longest`` words, each once."""
    of = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
    # bound, or each run would cut the text into words again
    return p.bound(words, lambda w: F.array_distinct(F.flatten(F.array_compact(F.array(*(of(w, n) for n in range(1, longest + 1)))))))


def city_names(cities: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """(key, commune, woj) of every name of a city: its own, and the inflected ones of ``forms`` (form, nominative)."""
    own = cities.select(ascii_key(F.col("name")).alias("key"), "commune", F.substring("commune", 1, 2).alias("woj"))
    if forms is None:
        return own.distinct()
    other = forms.filter("nominative IS NOT NULL").select(ascii_key(F.col("form")).alias("_form"), ascii_key(F.col("nominative")).alias("key"))
    return own.union(own.join(small(other), "key").select(F.col("_form").alias("key"), "commune", "woj")).distinct()


def infer_commune(listings: DataFrame, names: DataFrame) -> DataFrame:
    """(listing_id, commune) of the city that a listing names: by its commune, its precinct, then its description, text and title.

    The first of these that names a city of the listing's province decides (any province, if the listing's is not known), and in
    it the longest name, then the first in order of the alphabet.  ``names``: ``city_names``.
    """
    names = keep(names, "names")
    longest = names.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1  # one number
    text = F.coalesce("raw_text", F.lit(""))
    # up to the first of the offices that the text names behind its beginning; without one the description is the text, which is not searched twice
    ends = [F.instr(text, office) for office in OFFICES]
    cut = F.coalesce(*(F.when(at > 1, F.left(text, at - 1)) for at in ends), F.lit(""))
    whole = lambda name: F.array_compact(F.array(ascii_key(nominative(name))))
    sources = F.array(whole(F.col("raw_gmina")), whole(precinct_of(F.col("raw_obreb"))), *(runs_of(words_of(x), longest) for x in (cut, text, F.col("title"))))
    rows = spread(listings.select("listing_id", "raw_woj", "raw_gmina", "raw_obreb", "raw_text", "title")).select("listing_id", province_code(F.col("raw_woj")).alias("_woj"), F.posexplode(sources).alias("source", "keys")).select("listing_id", "_woj", "source", F.explode("keys").alias("key"))
    found = rows.join(small(names), "key").filter(F.col("_woj").isNull() | (F.col("_woj") == F.col("woj")))
    return found.groupBy("listing_id").agg(F.min_by("commune", F.struct("source", -F.length("key"), "key", "commune")).alias("commune"))


def resolve_by_text_locality(listings: DataFrame, cadastre: DataFrame) -> DataFrame:
    """By the localities in addresses of the text, in their order: the first one that leaves one candidate (C14)."""
    found = p.matches(F.col("raw_text"), ADDRESS[2], ADDRESS[3], ADDRESS[4])
    rows = listings.filter("raw_numer <> '' AND raw_text IS NOT NULL").select("listing_id", "area_m2", F.col("raw_numer").alias("_number"), province_code(F.col("raw_woj")).alias("_woj"), ascii_key(precinct_of(F.col("raw_obreb"))).alias("_own"), F.posexplode(found).alias("i", "m"))
    rows = rows.filter("i > 0").select("*", F.explode(p.names(F.col("m.name"))).alias("_name")).withColumn("_key", ascii_key(nominative(F.col("_name")))).filter("_key IS NOT NULL AND NOT _key <=> _own").drop("m", "_own", "_name")
    chosen = choose(rows.join(by_precinct(cadastre, "region_name"), ["_key", "_number"]), ["listing_id", "i"])
    return chosen.groupBy("listing_id").agg(F.min_by("cad_id", "i").alias("cad_id")).select("listing_id", "cad_id", F.lit("uldk_partial").alias("method"))


def _method(raw_kw: Column, other: str) -> Column:
    return F.when(F.coalesce(raw_kw, F.lit("")) != "", "kw_lookup").otherwise(other)


def _hints(listings: DataFrame, notices: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Listings with the numbers, precinct and text of their notice; an override by land register goes before."""
    rows = listings.join(notices.select("listing_id", "numbers", F.col("text").alias("_notice")), "listing_id", "left")
    if overrides is not None:
        o = small(overrides.select(F.col("kw").alias("_kw"), F.col("numbers").alias("_numbers"), F.col("obreb").alias("_obreb")))
        # only listings with a register meet overrides: a left join would send all others, which have no key, to one task
        over = listings.select("listing_id", F.upper(F.replace("raw_kw", F.lit(" "), F.lit(""))).alias("_kw")).filter("_kw IS NOT NULL").join(o, "_kw")
        rows = rows.join(over.select("listing_id", "_numbers", "_obreb"), "listing_id", "left")
        rows = rows.withColumn("numbers", F.coalesce("_numbers", "numbers"))
    else:
        rows = rows.withColumn("_obreb", F.lit(None).cast("string"))
    return rows.filter(F.size("numbers") > 0)


def resolve_by_notice(listings: DataFrame, notices: DataFrame, cadastre: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """All parcels of the numbers that a listing's notice, or an override for its land register, names; each number by itself."""
    rows = _hints(listings, notices, overrides).withColumn("_key", ascii_key(F.coalesce("_obreb", precinct_of(F.col("raw_obreb"))))).filter("_key IS NOT NULL")
    rows = rows.select("listing_id", "area_m2", "_key", province_code(F.col("raw_woj")).alias("_woj"), _method(F.col("raw_kw"), "uldk_partial").alias("method"), F.explode(F.array_distinct("numbers")).alias("_number"))
    return choose(rows.join(by_precinct(cadastre, "region_name"), ["_key", "_number"]), ["listing_id", "_number", "method"]).select("listing_id", "cad_id", "method").distinct()


def _in_register_province(listings: DataFrame) -> DataFrame:
    return listings.filter(province_code(F.col("raw_woj")) == REGISTERED)


def resolve_by_unit(listings: DataFrame, notices: DataFrame, units: DataFrame, cadastre: DataFrame) -> DataFrame:
    """By a district unit and a precinct number in the notice: precincts of a unit are named by its prefix and the number (C17).

    ``units``: name, prefix, commune.  The numbers are those between the word for parcels and the precinct, else all of the notice.
    """
    text = F.col("_notice")
    pattern = p.any_of("jedn. ewid.", "jednostk* ewidencyjn*") + rf"\s*:?\s*({p.NAME})\s*,?\s*{REGION}(\d{{1,4}})(?!\d)"
    inner = F.regexp_extract(text, p.any_of("dzialk*", "dz.") + rf"\s+{p.any_of('nr.')}\s*([\d/,\sa-z]+?)(?:,|\s)\s*(?:{p.any_of('jedn. ewid.', 'jednostk* ewidencyjn*')}|{REGION})", 1)
    context = F.regexp_extract_all(inner, F.lit(r"\d{1,5}(?:/\d{1,4})?"), 0)
    rows = _hints(_in_register_province(listings), notices, None).select(
        "listing_id", _method(F.col("raw_kw"), "manual").alias("method"), ascii_key(F.regexp_extract(text, pattern, 1)).alias("_unit"), F.regexp_extract(text, pattern, 2).alias("_digits"), F.when(F.size(context) > 0, context).otherwise(F.col("numbers")).alias("numbers")
    )
    rows = rows.filter("_unit <> '' AND _digits <> ''").join(small(units.select(ascii_key(F.col("name")).alias("_unit"), "prefix", "commune")), "_unit")
    rows = rows.select("listing_id", "method", "commune", F.concat("prefix", F.lit("-"), F.col("_digits").cast("int").cast("string")).alias("region_name"), F.explode(F.array_distinct("numbers")).alias("number"))
    return rows.join(cadastre.select("commune", "region_name", "number", "cad_id"), ["commune", "region_name", "number"]).select("listing_id", "cad_id", "method").distinct()


def resolve_by_register(listings: DataFrame, notices: DataFrame, register: DataFrame, rules: DataFrame) -> DataFrame:
    """By regional registers: the number in the communes, and precincts if named, that a rule allows for the locality.

    ``register``: cad_id, number, commune_name, region_name.  ``rules``: locality, commune_name, region_name (null: any).  A number
    counts only if one row of the register matches.
    """
    key = lambda c: ascii_key(F.col(c))
    locality = F.coalesce(F.nullif(ascii_key(F.coalesce("raw_gmina", F.lit(""))), F.lit("")), key("raw_obreb"))
    rows = _hints(_in_register_province(listings), notices, None).select("listing_id", _method(F.col("raw_kw"), "manual").alias("method"), locality.alias("_locality"), F.explode(F.array_distinct("numbers")).alias("number"))
    rows = rows.join(small(rules.select(key("locality").alias("_locality"), key("commune_name").alias("_commune"), key("region_name").alias("_region"))), "_locality")
    found = rows.join(register.select("number", "cad_id", key("commune_name").alias("_commune"), key("region_name").alias("_of")), ["number", "_commune"]).filter("_region IS NULL OR _region = _of")
    one = found.groupBy("listing_id", "number").agg(F.count_distinct("cad_id").alias("n"), F.min("cad_id").alias("cad_id"), F.min("method").alias("method")).filter("n = 1")
    return one.select("listing_id", "cad_id", "method").distinct()


def resolve_by_city(listings: DataFrame, cadastre: DataFrame, names: DataFrame) -> DataFrame:
    """By the commune of the city that a listing names: in the precinct that its text names by number, else in all.

    Of several the one whose precinct's name the text holds, then the one of the listing's area; each only if it is the only one.
    """
    named = F.regexp_extract(F.coalesce("raw_text", F.lit("")), REGION + r"(\d{1,4})(?!\d)", 1)
    rows = listings.filter("raw_numer <> ''").select("listing_id", F.col("raw_numer").alias("number"), "area_m2", F.when(named != "", F.lpad(named, 4, "0")).alias("_region"), F.concat(F.lit(" "), F.array_join(words_of(F.col("raw_text")), " "), F.lit(" ")).alias("_words"))
    precinct = F.concat(F.lit(" "), F.array_join(words_of(F.col("region_name")), " "), F.lit(" "))
    # names of precincts are cut into words once a parcel, not once a pair
    plots = cadastre.select("commune", "number", "cad_id", "region_code", precinct.alias("_precinct"), F.col("area_m2").alias("_area"))
    found = rows.join(infer_commune(listings, names), "listing_id").join(plots, ["commune", "number"])
    near = F.col("_area").between(F.col("area_m2") * 0.95, F.col("area_m2") * 1.05) & (F.col("area_m2") > 0)
    w = Window.partitionBy("listing_id")
    tests = {"explicit": F.col("region_code") == F.col("_region"), "only": F.lit(True), "told": F.contains("_words", F.col("_precinct")), "near": near}
    for name, test in tests.items():
        found = found.withColumn(name, F.coalesce(test, F.lit(False)))
    found = found.select("*", *(F.count_if(F.col(name)).over(w).alias(f"n_{name}") for name in tests))
    stage = F.coalesce(*(F.when(F.col(f"n_{name}") == 1, name) for name in tests))
    picked = F.coalesce(*(F.when(stage == name, F.col(name)) for name in tests))
    return found.filter(picked).select("listing_id", "cad_id", F.lit("uldk_partial").alias("method"))


def with_notice_parcels(resolved: DataFrame, listings: DataFrame, by_notice: DataFrame) -> DataFrame:
    """Listings that one parcel was found for and whose text speaks of parcels also get those of their notice (step 3b of C19)."""
    single = resolved.filter("cad_id IS NOT NULL").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("listing_id"))).filter("_n = 1").select("listing_id", "cad_id")
    talks = listings.filter(ascii_key(F.col("raw_text")).contains("dzial")).select("listing_id", "raw_kw")
    more = by_notice.select("listing_id", F.col("cad_id").alias("_more")).join(talks, "listing_id").join(single, "listing_id").filter("_more <> cad_id")
    by_kw = more.filter("raw_kw <> ''").select("listing_id").distinct().withColumn("_kw", F.lit(True))
    old = resolved.join(by_kw, "listing_id", "left").withColumn("method", F.when(F.col("_kw") & F.col("cad_id").isNotNull(), "kw_lookup").otherwise(F.col("method"))).drop("_kw")
    added = more.select("listing_id", F.col("_more").alias("cad_id")).join(old.select("listing_id", "method"), "listing_id")
    return old.select("listing_id", "cad_id", "method").unionByName(added)


def resolve_all(listings: DataFrame, notices: DataFrame, cadastre: DataFrame, cities: DataFrame, units: DataFrame, register: DataFrame, rules: DataFrame, overrides: DataFrame | None = None, forms: DataFrame | None = None) -> DataFrame:
    """Every listing with the parcels of the first of seven strategies that has any, with method, confidence and outcome."""
    names = city_names(cities, forms)
    # what most strategies read is made once
    register = None if register is cadastre else register
    listings, cadastre = keep(listings, "listings"), keep(cadastre, "cadastre")
    by_notice = keep(resolve_by_notice(listings, notices, cadastre, overrides), "by-notice")
    strategies = [
        resolve_by_id(listings, cadastre),
        resolve_by_name(listings.withColumn("raw_obreb", precinct_of(F.col("raw_obreb"))), cadastre, "region_name"),
        resolve_by_text_locality(listings, cadastre),
        by_notice,
        resolve_by_unit(listings, notices, units, cadastre),
        resolve_by_register(listings, notices, cadastre if register is None else register, rules),
        resolve_by_city(listings, cadastre, names),
    ]
    first = keep(resolve_cascade(listings, strategies), "resolved")
    both = with_notice_parcels(first.select("listing_id", "cad_id", "method"), listings, by_notice)
    outcome = first.select("listing_id", "outcome").distinct()
    pairs = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return both.join(outcome, "listing_id").select("listing_id", "cad_id", "method", F.element_at(pairs, F.col("method")).cast("decimal(3,2)").alias("match_confidence"), "outcome")
