"""Extraction jobs: tables of texts to tables of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.functions import text as t
from landspark.functions.places import bound

CODE = r"([A-Z]{2}[0-9][A-Z])"
#: Passes over a text, the strictest first: pattern of court, number and check digit, the source it counts as, base confidence.
PASSES = (
    (rf"(?<![A-Z0-9]){CODE}/(\d{{8}})/(\d)(?![A-Z0-9/])", "free_text_regex", 0.80),
    (rf"(?i)(?<![A-Z0-9]){CODE}[\s/-]+(\d{{8}})[\s/-]+(\d)(?![A-Z0-9])", "relaxed_regex", 0.70),
)
#: Wherever one of the passes, or the partial one, finds a number, this does; its matches never overlap one another.
ANY_NUMBER = r"(?<![A-Z0-9])(?i)[A-Z]{2}[0-9][A-Z][\s/-]+\d{8}"
PARTIAL = rf"(?i)(?<![A-Z0-9/]){CODE}[\s/-](\d{{8}})(?![\s/-]*\d)(?![A-Z0-9])"


SOURCES = (*((source, base) for _, source, base in PASSES), ("no_check_digit", 0.45))
#: What stands between the parts of a number; and check digits, the missing one last.
SEPARATORS, DIGITS = " \t\n\x0b\f\r/-", "0123456789?"


def extract_registers(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Land-register numbers of each text: normalised, check_valid, court_known, confidence, source and flag.

    A number that a stricter pass found is not found again by a looser one; within a pass numbers that differ in their check
    digit are two.  Numbers without a check digit come last, with a question mark in its place, at a confidence of 0.45, or
    0.30 if the court is unknown.
    """
    text = F.col(text_col)
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 0)
    of_pass = lambda values, k: F.transform(values, lambda raw: F.struct(F.lit(k).alias("pass"), F.translate(raw, SEPARATORS, "").alias("raw")))
    looser = [of_pass(found(pattern), k) for k, pattern in enumerate((PASSES[1][0], PARTIAL), 1)]
    # where the strictest pass finds a number at every place that any pass can, the looser ones add nothing
    every = lambda strict: F.when(F.regexp_count(text, F.lit(ANY_NUMBER)) > F.size(strict), F.concat(of_pass(strict, 0), *looser)).otherwise(of_pass(strict, 0))
    hits = docs.select(F.col(id_col).alias("doc_id"), F.explode(bound(found(PASSES[0][0]), every)).alias("hit")).select("doc_id", F.upper(F.left("hit.raw", F.lit(4))).alias("court"), F.substring("hit.raw", 5, 8).alias("number"), F.substring("hit.raw", 13, 1).alias("digit"), "hit.pass")
    # of a number, each pass's check digits as bits, so that a row is shuffled once
    bit = F.when(F.col("digit") == "", 1 << 10).otherwise(F.pow(F.lit(2), F.col("digit").cast("int")).cast("int"))
    digits = [F.bit_or(F.when(F.col("pass") == k, bit)).alias(f"_{k}") for k in range(len(SOURCES))]
    first = hits.groupBy("doc_id", "court", "number").agg(*digits).select("doc_id", "court", "number", F.coalesce(*(F.when(F.col(f"_{k}").isNotNull(), F.struct(F.lit(source).alias("source"), F.lit(base).alias("base"), F.col(f"_{k}").alias("bits"))) for k, (source, base) in enumerate(SOURCES))).alias("_s"))
    digit = F.filter(F.array(*(F.when(F.col("_s.bits").bitwiseAND(1 << i) != 0, d) for i, d in enumerate(DIGITS))), lambda d: d.isNotNull())
    out = first.select("doc_id", "court", "number", "_s.source", "_s.base", F.explode(digit).alias("digit"))
    unknown = F.col("digit") == "?"
    # a column of its own, for it is asked for several times
    out = out.withColumn("_valid", F.when(unknown, False).otherwise(t.check_digit(F.col("court"), F.col("number")).cast("string") == F.col("digit")))
    valid, known = F.col("_valid"), F.col("court").isin(*t.COURTS)
    full = F.round(F.greatest(F.when(valid, F.col("base")).otherwise(0.25) - F.when(known, 0.0).otherwise(0.05), F.lit(0.0)), 2)
    return out.select(
        "doc_id",
        F.concat_ws("/", "court", "number", "digit").alias("normalized"),
        F.coalesce(valid, F.lit(False)).alias("check_valid"),
        known.alias("court_known"),
        F.when(unknown, F.when(known, 0.45).otherwise(0.30)).otherwise(full).alias("confidence"),
        "source",
        F.when(~unknown & ~valid, "KW_CHECK_DIGIT_INVALID").when(~known, "KW_COURT_CODE_UNKNOWN").alias("flag"),
    )


def extract_listings(docs: DataFrame, id_col: str = "listing_id", text_col: str = "text") -> DataFrame:
    """One row for each notice: price, area, date, case number and place."""
    text = F.col(text_col)
    place = t.extract_location(text)
    return docs.select(
        id_col, t.extract_price(text).alias("price"), t.extract_area(text).alias("area_m2"), t.extract_date(text).alias("auction_date"), t.extract_case(text).alias("case_number"),
        place["gmina"].alias("gmina"), place["powiat"].alias("powiat"), place["province"].alias("province"),
    )


LAND = r"(?iu)dzia[łl]k|grunt|niezabudowan|roln|budowlan"


def filter_land(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Notices that speak of land."""
    return docs.filter(F.col(text_col).rlike(LAND))


def filter_province(rows: DataFrame, provinces: list[str]) -> DataFrame:
    """Rows of the provinces; an unknown province stays in."""
    # bound, for a filter moves below the steps that make the province and names it twice
    return rows.filter(bound(F.lower("province"), lambda p: p.isNull() | p.isin(*provinces)))


def extract_links(pages: DataFrame) -> DataFrame:
    """Each address that a page links to, with its place among the page's links."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\""), 1)
    return pages.select("page_id", F.posexplode(links).alias("position", "href"))


def extract_title(pages: DataFrame) -> DataFrame:
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", F.nullif(t.html_to_text(title), F.lit("")).alias("title"))
