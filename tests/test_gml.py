"""GML in the forms that services send."""

from pyspark.sql import functions as F

from landspark.functions import geometry as g
from landspark.sources import gml

RING = "<g:LinearRing><g:posList>{}</g:posList></g:LinearRing>"
SQUARE, HOLE = "0 0 0 10 10 10 10 0 0 0", "2 2 4 2 4 4 2 4 2 2"
PLAIN = f"<g:Polygon><g:exterior>{RING.format(SQUARE)}</g:exterior></g:Polygon>"
HOLED = f"<g:Polygon><g:exterior>{RING.format(SQUARE)}</g:exterior><g:interior>{RING.format(HOLE)}</g:interior></g:Polygon>"
TEXTS = {
    "holed": (f"<c><member><z><a>x</a><geom>{HOLED}</geom></z></member></c>", [("x", 96)]),
    "two members, one without shape": (f"<w:c xmlns:w='u'><w:member><z><a>x</a></z></w:member><w:member><z><a>y</a><s>{PLAIN}</s></z></w:member></w:c>", [("y", 100)]),
    "3d on the list": ("<c><member><z><a>x</a><s>" + PLAIN.replace("<g:posList>" + SQUARE, "<g:posList srsDimension='3'>0 0 5 0 10 5 10 10 5 10 0 5 0 0 5") + "</s></z></member></c>", [("x", 100)]),
    "many polygons": (f"<c><featureMember><z><a>x</a><s><g:MultiSurface><g:surfaceMember>{HOLED}</g:surfaceMember><g:surfaceMember>{PLAIN.replace('10', '20')}</g:surfaceMember></g:MultiSurface></s></z></featureMember></c>", [("x", 496)]),
    "children of the root": (f"<?xml version='1.0'?>\n<c><boundedBy><e>1</e></boundedBy><z><a>x</a><s>{PLAIN}</s></z><z><a>y</a><b/><s>{PLAIN}</s></z></c>", [("x", 100), ("y", 100)]),
    "list of members": (f"<c><members><z><A> &lt;x&gt;\n</A><s>{PLAIN}</s></z></members></c>", [("<x>", 100)]),
    "exception": ("<ows:ExceptionReport><ows:Exception><a>x</a></ows:Exception></ows:ExceptionReport>", []),
    "no numbers": (f"<c><member><z><a>x</a><s>{PLAIN.replace(SQUARE, 'a b c')}</s></z></member></c>", []),
    "two points": (f"<c><member><z><a>x</a><s>{PLAIN.replace(SQUARE, '0 0 1 1')}</s></z></member></c>", []),
    "no xml": ("404 not found", []),
    "empty": ("", []),
    "null": (None, []),
}


def test_forms(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in TEXTS.items()], "source_id string, body string")
    out = gml.read_features(rows).select("source_id", gml.field(F.lit("a")).alias("a"), g.area(F.col("geom")).alias("area")).collect()
    assert {k: sorted((r.a, r.area) for r in out if r.source_id == k) for k in TEXTS} == {k: v[1] for k, v in TEXTS.items()}


def test_extents(spark):
    body = f"<c><member><z><tytul>Plan</tytul><identifier>U/1</identifier><obowiazujeOd>2026-05-04</obowiazujeOd><s>{PLAIN}</s></z></member><member><z><s>{PLAIN}</s></z></member></c>"
    rows = gml.ingest_plan_extents(spark.createDataFrame([(1, "126101199", body)], "source_id int, teryt_gmina string, body string")).collect()
    assert [(r.teryt_gmina, r.symbol, r.plan_name, r.resolution, r.description, str(r.effective_date)) for r in rows] == [("1261011", "MPZP_PROJ", "Plan", "U/1", "APP project extent: Plan", "2026-05-04")]
