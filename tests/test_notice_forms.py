"""Prices, registers, rings and provinces in the forms that notices and services really have."""

import json

import pytest
from pyspark.sql import functions as F

from landspark.functions import text as t
from landspark.functions import geometry as g
from landspark.operators import resolve
from landspark.operators import text as ops
from landspark.sources import geojson

PRICES = {
    "Cena wywoławcza wynosi 853 333,33 zł, wadium 20 000 zł.": 853333.33,
    "Wadium wynosi 20 000 zł.": None,
    "opłata 500 zł i 45 000 zł": 45000,
    "wadium w 2 ratach 5 000 zł": None,
    "cena wywołania 129.000,00 PLN": 129000,
    "suma oszacowania wynosi 200 000 zł, cena wywołania kwotę 150 000 zł": 150000,
    "za cenę nie niższą niż 12 500,50 zł": 12500.5,
    "stanowiąca 3/4 sumy oszacowania, to jest 75 000 zł; suma oszacowania 100 000 zł": 100000,
    "stanowiąca 3/4 sumy oszacowania, to jest 75 000 zł": 75000,
    "oszacowana na kwotę 1,234,567.89 zł": 1234567.89,
    "udział 1/2 o wartości 60 000 zł, dom 90 000 zł i auto 70 000 zł": 90000,
    "cena wywołania 999 zł, inna 5 000 zł": 5000,
    "koszt 3 000 zł. A dalej, po długim zdaniu o czymś zupełnie innym, jest 8 000 zł": 8000,
    "bez kwoty": None,
    "": None,
    None: None,
    "1 zł " * 5000 + "cena nabycia 40 000 zł": 40000,
}


def test_prices(spark):
    rows = list(PRICES)
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, text string").select("i", t.extract_price(F.col("text")).cast("double").alias("p")).collect()
    assert {rows[r.i]: r.p for r in got} == PRICES


DECIMALS = {"129 000,00": 129000, "1.234,56": 1234.56, "1,234.56": 1234.56, "1.234.567": 1234567, "1,234,567": 1234567, "12,5": 12.5, "12.345": 12345, "7": 7, "1.234.56": 1234.56, "": None, "-5,25": -5.25}


def test_decimals(spark):
    got = spark.createDataFrame([(x,) for x in DECIMALS], "x string").select("x", t.parse_decimal(F.col("x")).cast("double").alias("v")).collect()
    assert {r.x: r.v for r in got} == DECIMALS


REGISTERS = {
    "KW WA1M/00012345/2.": [("WA1M/00012345/2", "free_text_regex")],
    "wa1m / 00012345 / 2": [("WA1M/00012345/2", "relaxed_regex")],
    "WA1M//00012345//2": [("WA1M/00012345/2", "relaxed_regex")],
    "WA1M-00012345-2": [("WA1M/00012345/2", "relaxed_regex")],
    "WA1M / 123456 / 2": [],
    "KR1K/00077712 i dalej": [("KR1K/00077712/?", "no_check_digit")],
    "WA1M/00012345/2 oraz WA1M 00012345 2": [("WA1M/00012345/2", "free_text_regex")],
    "WA1M/00012345/22": [],
    "XWA1M/00012345/2": [],
}


def test_registers(spark):
    texts = list(REGISTERS)
    got = ops.extract_registers(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string"), "i").collect()
    found = {x: [] for x in texts}
    for r in got:
        found[texts[r.doc_id]].append((r.normalized, r.source))
    assert {k: sorted(v) for k, v in found.items()} == REGISTERS
    by = {r.normalized: r for r in got}
    assert by["KR1K/00077712/?"].confidence == 0.45 and not by["KR1K/00077712/?"].check_valid and by["KR1K/00077712/?"].flag is None


def test_rings_with_holes(spark):
    outer = [[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]]
    hole = [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]
    apart = [[20, 0], [20, 5], [25, 5], [25, 0], [20, 0]]
    cases = {1: ([outer], 100, 1), 2: ([outer, hole], 96, 1), 3: ([outer, hole, apart], 121, 2), 4: ([outer[::-1], hole[::-1]], 96, 1)}
    df = spark.createDataFrame([(i, json.dumps({"rings": r})) for i, (r, _, _) in cases.items()], "source_id int, json string")
    got = {r.source_id: (r.a, r.n) for r in geojson.from_esri_rings(df).select("source_id", g.area(F.col("geom")).alias("a"), F.size("geom").alias("n")).collect()}
    assert got == {i: (pytest.approx(a), n) for i, (_, a, n) in cases.items()}


def test_every_province_has_its_code(spark):
    assert len(set(t.PROVINCE_CODES.values())) == len(t.PROVINCE_CODES) == 16
    got = spark.createDataFrame([(" Zachodniopomorskie ",), ("warmińsko-mazurskie",), ("nowe",)], "x string").select(resolve.province_code(F.col("x")).alias("c")).collect()
    assert [r.c for r in got] == ["32", "28", None]
