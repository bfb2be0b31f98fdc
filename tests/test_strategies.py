"""Strategies of resolution by cases, null and empty input, repeated rows."""

import pytest

from landspark.operators import strategies as ops

LISTINGS = "listing_id long, raw_obreb string, raw_numer string, raw_woj string, raw_gmina string, raw_kw string, area_m2 double, raw_text string, title string, number string"
CADASTRE = "cad_id string, commune string, region_code string, region_name string, number string, woj string, area_m2 double, commune_name string"
NOTICES = "listing_id long, numbers array<string>, text string"
CITIES = [("Kraków", "1261011"), ("Nowy Sącz", "1262011"), ("Sącz", "1299011"), ("Knurów", "2405011"), ("Gliwice", "2466011")]
FORMS = [("Krakowie", "Kraków"), ("Nowym Sączu", "Nowy Sącz"), ("Sączu", "Sącz"), ("Gliwicach", "Gliwice"), ("Stodolska", None)]


def listing(i, obreb=None, numer=None, woj=None, gmina=None, kw=None, area=None, text=None, title=None):
    return (i, obreb, numer, woj, gmina, kw, area, text, title, "x")


@pytest.fixture(scope="module")
def names(spark):
    return ops.city_names(spark.createDataFrame(CITIES, "name string, commune string"), spark.createDataFrame(FORMS, "form string, nominative string"))


def test_communes(spark, names):
    rows = {
        1: (listing(1, "Podgórze", woj="małopolskie", text="działka położona w Krakowie Komornik Sądowy dla Gliwic, Knurów"), "1261011"),
        2: (listing(2, "Nowym Sączu", woj="małopolskie", text="w obrębie 32 w Krakowie"), "1262011"),
        3: (listing(3, None, woj="śląskie", text="położona w Knurowie, Knurów"), "2405011"),
        4: (listing(4, None, woj="małopolskie", text="w Gliwicach i w Krakowie"), "1261011"),
        5: (listing(5, None, text="w Nowym Sączu i w Krakowie"), "1262011"),
        6: (listing(6, None, woj="małopolskie", text="w Sączu"), "1299011"),
        7: (listing(7, None, text="Krakowiec, Gliwiceum"), None),
        8: (listing(8, None, title="Kraków - dom"), "1261011"),
        9: (listing(9, None, gmina="Knurów", text="w Krakowie"), "2405011"),
        10: (listing(10), None),
        11: (listing(11, None, text=""), None),
        12: (listing(12, None, text="słowo " * 5000 + "Kraków"), "1261011"),
    }
    got = {r.listing_id: r.commune for r in ops.infer_commune(spark.createDataFrame([r for r, _ in rows.values()], LISTINGS), names).collect()}
    assert {i: got.get(i) for i in rows} == {i: c for i, (_, c) in rows.items()}


PLOTS = [
    ("1261011.0005.7", "1261011", "0005", "Łąki", "7", "12", 500.0, "Kraków"),
    ("1261011.0009.7", "1261011", "0009", "Bory Górne", "7", "12", 900.0, "Kraków"),
    ("1261011.0009.8", "1261011", "0009", "Bory Górne", "8", "12", 900.0, "Kraków"),
    ("1261011.0094.3", "1261011", "0094", "P-94", "3", "12", 300.0, "Kraków"),
    ("2405011.0001.7", "2405011", "0001", "Łąki", "7", "24", 510.0, "Knurów"),
    ("2405011.0001.9", "2405011", "0001", "Łąki", "9", "24", 510.0, "Knurów"),
    ("2466011.0001.7", "2466011", "0001", "Kłyż", "7", "24", 1.0, "Gliwice"),
]


@pytest.fixture(scope="module")
def cadastre(spark):
    return spark.createDataFrame(PLOTS, CADASTRE)


def pairs(df):
    return sorted((r.listing_id, r.cad_id, r.method) for r in df.collect())


def test_by_text_locality(spark, cadastre):
    text = "Adres nieruchomości 33-250 {}, poczta Otfinów"
    rows = [listing(1, "Tarnów", "7", text=text.format("Kłyż")), listing(2, "Kłyż", "7", text=text.format("Kłyż")), listing(3, None, "7", "śląskie", text=text.format("Łąki")), listing(4, None, "7", text=text.format("Łąki")), listing(5, None, "7", area=500.0, text=text.format("Łąki")), listing(6, None, "7"), listing(7, None, None, text=text.format("Kłyż"))]
    rows.append(listing(8, None, "7", text=text.format("Polna, 33-250 Nigdzie") + " oraz " + text.format("Kłyż")))
    assert pairs(ops.resolve_by_text_locality(spark.createDataFrame(rows, LISTINGS), cadastre)) == [(1, "2466011.0001.7", "uldk_partial"), (3, "2405011.0001.7", "uldk_partial"), (8, "2466011.0001.7", "uldk_partial")]


def test_by_notice_and_override(spark, cadastre):
    rows = [listing(1, "Bory Górne"), listing(2, "0001 Łąki", woj="śląskie", kw="GL1G/1"), listing(3, None, kw="KW 9"), listing(4, "Bory Górne", kw="KW9"), listing(5, None)]
    notices = spark.createDataFrame([(1, ["7", "8", "8", "77"], None), (2, ["7", "9"], None), (5, ["7"], None), (4, [], None)], NOTICES)
    overrides = spark.createDataFrame([("KW9", ["3"], "P-94")], "kw string, numbers array<string>, obreb string")
    assert pairs(ops.resolve_by_notice(spark.createDataFrame(rows, LISTINGS), notices, cadastre, overrides)) == [
        (1, "1261011.0009.7", "uldk_partial"), (1, "1261011.0009.8", "uldk_partial"), (2, "2405011.0001.7", "kw_lookup"), (2, "2405011.0001.9", "kw_lookup"), (3, "1261011.0094.3", "kw_lookup"), (4, "1261011.0094.3", "kw_lookup"),
    ]


def test_by_unit(spark, cadastre):
    units = spark.createDataFrame([("Podgórze", "P", "1261011")], "name string, prefix string, commune string")
    rows = [listing(i, None, None, w) for i, w in ((1, "małopolskie"), (2, "śląskie"), (3, "małopolskie"), (4, "małopolskie"))]
    notices = spark.createDataFrame([(1, ["5", "6"], "działki nr 2, 3 oraz 4, jedn. ewid. Podgórze, obręb 94"), (2, ["3"], "jedn. ewid. Podgórze, obręb 94"), (3, ["3"], "jednostka ewidencyjna PODGÓRZE obręb nr 94"), (4, ["3"], "jedn. ewid. Inna, obręb 94")], NOTICES)
    assert pairs(ops.resolve_by_unit(spark.createDataFrame(rows, LISTINGS), notices, units, cadastre)) == [(1, "1261011.0094.3", "manual"), (3, "1261011.0094.3", "manual")]


def test_by_register(spark, cadastre):
    rules = spark.createDataFrame([("Kraków", "Kraków", "Bory Górne"), ("Łąki", "Kraków", None)], "locality string, commune_name string, region_name string")
    rows = [listing(1, None, None, "małopolskie", "Kraków"), listing(2, "Łąki", None, "Małopolskie", kw="k"), listing(3, None, None, "śląskie", "Kraków"), listing(4, None, None, "małopolskie", "Gdzie")]
    notices = spark.createDataFrame([(i, ["7", "8"], None) for i in (1, 2, 3, 4)], NOTICES)
    # number 7 has two rows where any precinct counts
    assert pairs(ops.resolve_by_register(spark.createDataFrame(rows, LISTINGS), notices, cadastre, rules)) == [(1, "1261011.0009.7", "manual"), (1, "1261011.0009.8", "manual"), (2, "1261011.0009.8", "kw_lookup")]


def test_by_city(spark, cadastre, names):
    rows = [
        listing(1, None, "7", text="Kraków, obręb nr 5"), listing(2, None, "8", text="w Krakowie"), listing(3, None, "7", text="w Krakowie, Bory Górne"), listing(4, None, "7", area=890.0, text="w Krakowie"),
        listing(5, None, "7", text="w Krakowie"), listing(6, None, "7", text="w Krakowie, obręb 77, Łąki"), listing(7, None, "", text="w Krakowie"), listing(8, None, "7", text="nigdzie"),
    ]
    assert [x[:2] for x in pairs(ops.resolve_by_city(spark.createDataFrame(rows, LISTINGS), cadastre, names))] == [(1, "1261011.0005.7"), (2, "1261011.0009.8"), (3, "1261011.0009.7"), (4, "1261011.0009.7"), (6, "1261011.0005.7")]


def test_whole_cascade(spark, cadastre):
    rows = [listing(1, "126101109", "8", text="działki"), listing(2, "Bory Górne", "8", text="działki", kw="k"), listing(3, None, "7"), listing(4, "Nigdzie", ""), listing(5, "Nigdzie", "5"), listing(6)]
    notices = spark.createDataFrame([(2, ["7", "8"], None)], NOTICES)
    cities, forms = spark.createDataFrame(CITIES, "name string, commune string"), spark.createDataFrame(FORMS, "form string, nominative string")
    units = spark.createDataFrame([], "name string, prefix string, commune string")
    rules = spark.createDataFrame([], "locality string, commune_name string, region_name string")
    got = ops.resolve_all(spark.createDataFrame(rows, LISTINGS), notices, cadastre, cities, units, cadastre, rules, None, forms).collect()
    assert sorted((r.listing_id, r.cad_id or "", r.method or "", float(r.match_confidence or 0), r.outcome) for r in got) == [
        (1, "1261011.0009.8", "teryt_exact", 0.98, "resolved"), (2, "1261011.0009.7", "kw_lookup", 0.92, "resolved"), (2, "1261011.0009.8", "kw_lookup", 0.92, "resolved"),
        (3, "", "", 0.0, "missing_precinct"), (4, "", "", 0.0, "missing_parcel_number"), (5, "", "", 0.0, "not_found_or_ambiguous"), (6, "", "", 0.0, "missing_parcel_number"),
    ]
    none = spark.createDataFrame([], LISTINGS)
    assert ops.resolve_all(none, notices, cadastre, cities, units, cadastre, rules, None, forms).count() == 0
