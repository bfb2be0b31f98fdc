"""A fresh extraction is made once, however many steps of a repair read it."""

import __spark_entry__ as entry
from landspark.operators import repair

SF = "/root/testdata/sf0.001"


def test_notices_are_read_once_a_step(spark):
    """Places, numbers, precincts and the listings themselves: the places are kept, and the rest is read once each."""
    plan = entry.queries()["h24_reparse"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation [l_orderkey" in x for x in plan.splitlines()) <= 3, plan
    assert plan.count("Window ") <= 3


def test_hints_of_several_sources(spark):
    """The unit's name replaces any; the address's one unless the text plainly names the stored precinct; hints without a name count for none."""
    listings = spark.createDataFrame([(k, "12/1", stored, None, "tekst") for k, stored in ((1, "Stara Wola"), (2, "Stara Wola"), (3, "Stara Wola"), (4, "Stara Wola"))], "listing_id long, raw_numer string, raw_obreb string, raw_gmina string, raw_text string")
    parcels = spark.createDataFrame([], "doc_id long, number string, confidence double, raw string, precinct_raw string, offset int")
    hints = [(1, "Nowa", "ewid_unit"), (1, "Stara Wola", "context"), (2, "Nowa", "address_locality"), (3, "Nowa", "address_locality"), (3, "Stara Wola", "context"), (3, None, "ewid_unit"), (4, "Nowa", "context")]
    localities = spark.createDataFrame(hints, "doc_id long, name string, source string")
    precincts = spark.createDataFrame([(k, "Nowa") for k in (1, 2, 3, 4)], "doc_id long, precinct_raw string")
    got = {r.listing_id: (r.precinct_action, r.new_obreb) for r in repair.reparse(listings, parcels, localities, precincts).collect()}
    assert got == {1: ("replace", "Nowa"), 2: ("replace", "Nowa")}
