"""Registered queries of text extraction, over derived notices and the driver's pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from landspark.fixtures import derived, duck
from landspark.functions import text as t
from landspark.operators import text as ops
from landspark.queries import query

NOTICES = f"WITH {duck('fx_notices')}"


@query("h10_extract_price", f"{NOTICES} SELECT listing_id, CASE WHEN price_zl BETWEEN 1000 AND 100000000 THEN price_zl END AS price FROM fx_notices")
def h10_extract_price(spark, sf_dir):
    """The price that each notice names; the deposit is none."""
    return derived(spark, sf_dir, "fx_notices").select("listing_id", t.extract_price(F.col("text")).alias("price"))


@query("h13_extract_listings", f"{NOTICES} SELECT listing_id, CASE WHEN price_zl >= 1000 THEN price_zl END AS price, (200 + listing_id % 3000)::DECIMAL(18,2) AS area_m2, DATE '2026-05-15' AS auction_date, 'Km ' || (listing_id % 900 + 1) || '/25' AS case_number, 'Skawina' AS gmina, 'krakowski' AS powiat, ['małopolskie', 'podkarpackie', 'śląskie'][listing_id % 3 + 1] AS province FROM fx_notices")
def h13_extract_listings(spark, sf_dir):
    """Price, area, date, case number and place of each notice."""
    return ops.extract_listings(derived(spark, sf_dir, "fx_notices"))


DIGITS = "list_transform(string_split(court, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END)"


@query(
    "h1_extract_registers",
    f"""{NOTICES}, r AS (SELECT listing_id, ['WA1M', 'GD4K', 'PO1P', 'KR1K'][listing_id % 4 + 1] AS court, lpad(listing_id::VARCHAR, 8, '0') AS number, listing_id % 10 AS digit FROM fx_notices),
d AS (SELECT *, string_split(array_to_string({DIGITS}, '') || number, '') AS ds FROM r),
v AS (SELECT *, list_sum(list_transform(range(1, len(ds) + 1), lambda i: ds[i]::INT * [1, 3, 7][(i - 1) % 3 + 1])) % 10 = digit AS ok FROM d)
SELECT listing_id AS doc_id, court || '/' || number || '/' || digit AS normalized, ok AS check_valid, TRUE AS court_known, CASE WHEN ok THEN 0.8 ELSE 0.25 END::DOUBLE AS confidence, 'free_text_regex' AS source, CASE WHEN NOT ok THEN 'KW_CHECK_DIGIT_INVALID' END AS flag FROM v""",
)
def h1_extract_registers(spark, sf_dir):
    """Land-register numbers with check digit, confidence and flag (H1, H2, H3)."""
    return ops.extract_registers(derived(spark, sf_dir, "fx_notices"), "listing_id")


@query("h14_filters", f"{NOTICES} SELECT listing_id FROM fx_notices WHERE listing_id % 3 < 2")
def h14_filters(spark, sf_dir):
    """Land notices of two provinces."""
    rows = ops.filter_land(derived(spark, sf_dir, "fx_notices"))
    return ops.filter_province(rows.select("listing_id", t.extract_location(F.col("text"))["province"].alias("province")), ["małopolskie", "podkarpackie"]).select("listing_id")


ENT = "h"
for _name, _char in t.ENTITIES:
    ENT = f"replace({ENT}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query("h15_html_to_text", f"WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\\b.*?</script\\s*>', ' ', 'gis'), '<style\\b.*?</style\\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs') AS h FROM pages) SELECT page_id, md5(trim(regexp_replace({ENT}, '\\s+', ' ', 'g'))) AS text_md5 FROM a")
def h15_html_to_text(spark, sf_dir):
    """Plain text of every page."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(t.html_to_text(F.col("html"))).alias("text_md5"))


@query("h17_extract_links", "WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1, 'i') AS x FROM pages) SELECT page_id, unnest(range(0, len(x)))::INT AS position, unnest(x) AS href FROM l")
def h17_extract_links(spark, sf_dir):
    """Links of every page."""
    return ops.extract_links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("h18_ascii_key", "SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'ąćęłńóśźż', 'acelnoszz'), '[\\s\\-]+', ' ', 'g'))) AS k FROM documents")
def h18_ascii_key(spark, sf_dir):
    """Folded keys of whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(t.ascii_key(F.col("text"))).alias("k"))


@query("h9_parse_decimal", """
WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_extendedprice::DECIMAL(14,2) AS v FROM lineitem)
SELECT v, count(*) AS n FROM n GROUP BY v""")
def h9_parse_decimal(spark, sf_dir):
    """Amounts in four notations parsed back (H9)."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_extendedprice").cast("decimal(14,2)").alias("v"))
    english = F.format_number("v", 2)
    plain = F.col("v").cast("string")
    polish = F.translate(F.translate(english, ",", " "), ".", ",")
    dotted = F.translate(F.translate(F.translate(english, ",", "#"), ".", ","), "#", ".")
    text = F.when(F.col("k") % 4 == 0, english).when(F.col("k") % 4 == 1, plain).when(F.col("k") % 4 == 2, F.concat(polish, F.lit(" zł"))).otherwise(dotted)
    return rows.select(t.parse_decimal(text).cast("decimal(14,2)").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
