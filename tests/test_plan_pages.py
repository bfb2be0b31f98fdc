"""Plan registers, legend sheets, hints and point answers by cases: odd markup, missing parts, empty tables."""

from landspark.operators import plan_pages as ops

PAGE = "source_id long, source_url string, body string"


def cells(*texts):
    return "".join(f"<td>{t}</td>" for t in texts)


def test_register_rows(spark):
    link = lambda h: f"<a href='{h}'>x</a>"
    good = cells("<b>K 1</b>", "Plan &amp; <i>Lipa</i>", *"23456", link("leg/index.html"), link("/app"), "9", link("../t.tif"), "11", link("https://m.test/?resources=map:wms@https%3A%2F%2Fw.test%2Fcgi-bin%2F126101&amp;bbox=1,2.5, 3,4"))
    rows = [
        f"<tr class='mpzp odd'>{good}</tr>", f"<TR CLASS=\"x mpzp\">{cells('K2', *['x'] * 11, link('https://m.test/?bbox=1,2,x,4'))}</TR>", f"<tr class='other'>{good}</tr>", f"<tr class='mpzp'>{cells('K3', *'23456789')}</tr>",
        f"<tr class='mpzp'>{cells(' ', *['x'] * 12)}</tr>", f"<tr class='mpzp'>{cells('K4', *['x'] * 12)}",
    ]
    pages = spark.createDataFrame([(1, "https://p.test/a/b.html", "<table>" + "".join(rows)), (2, "https://p.test/", ""), (3, "https://p.test/", None)], PAGE)
    got = {r.plan_code: r for r in ops.plan_register(pages).collect()}
    assert set(got) == {"K 1", "K2", "K4"}
    r = got["K 1"]
    assert (r.name, r.legend_url, r.app_url, r.picture_url, r.wms_url, r.area_code) == ("Plan & Lipa", "https://p.test/a/leg/index.html", "https://p.test/app", "https://p.test/t.tif", "https://w.test/cgi-bin/126101", "126101")
    assert (r.minx, r.miny, r.maxx, r.maxy) == (1, 2.5, 3, 4)
    assert got["K2"].minx is None and got["K2"].wms_url is None and got["K4"].map_url is None


def test_sheets_and_entries(spark):
    documents = spark.createDataFrame([(1, "https://p.test/l/index.html", '<link rel=x href="sheet001.html"><link href="s/Sheet002.htm"><link href="style.css"><link href="sheet001.html">'), (2, "https://p.test/l/", "<a href='a/sheet7.html'>x</a><a href='b.html'>"), (3, "https://p.test/", None)], PAGE)
    assert sorted((r.source_id, r.i, r.sheet_url) for r in ops.sheet_links(documents).collect()) == [(1, 0, "https://p.test/l/sheet001.html"), (1, 1, "https://p.test/l/s/Sheet002.htm"), (2, 0, "https://p.test/l/a/sheet7.html")]
    body = (
        "<tr><td>Legenda</td></tr><tr><td>dla Lipy</td></tr><tr><td><img src=' '></td><td>1MN</td></tr><tr><td><img src='a.png'><img src='a.png'></td><td>1MN</td><td>tereny 1MN-2</td></tr>"
        "<tr><td><img src='a.png'></td><td>tereny 1MN-2</td></tr><tr><td>bez obrazka</td></tr><tr><td><img src='/b.png'></td><td>LEGENDA b</td></tr><tr><td><img src='c.png'></td><td>zabudowa mieszkaniowa</td></tr>"
    )
    got = ops.legend_entries(spark.createDataFrame([(1, "https://p.test/l/s.html", body), (2, "https://p.test/", None)], PAGE)).collect()
    assert sorted((r.title, r.image_url, r.label, r.designation) for r in got) == [("Lipy", "https://p.test/l/a.png", "tereny 1MN-2", "TERENY"), ("Lipy", "https://p.test/l/c.png", "zabudowa mieszkaniowa", None)]


HINTS = [
    ({"Oznaczenie": "1MN", "nr planu": " KN  12 "}, None, ("MN", "KN 12")),
    ({"inne": "x"}, "oznaczenie=2U; numer planu: P/1", ("U", "P/1")),
    ({"symbol": "EXTENT"}, "a\nstrefa : 3.MW/U.\nuchwała=7", (".MW/U", None)),
    (None, "teren KDL przy drodze", ("TEREN", None)),
    (None, "przeznaczony pod 12MN/U", ("POD", None)),
    ({"plan": None, "plan b": "x"}, "", (None, "x")),
    ({}, None, (None, None)),
    (None, None, (None, None)),
]


def test_hints(spark):
    rows = spark.createDataFrame([(i, a, t) for i, (a, t, _) in enumerate(HINTS)], "id int, attributes map<string,string>, raw_text string")
    assert {r.id: (r.designation_hint, r.plan_name_hint) for r in ops.feature_hints(rows).collect()} == {i: h[2] for i, h in enumerate(HINTS)}


def test_point_answers(spark):
    answers = {
        "@MPZP - przeznaczenia OBJECTID;numerplanu;symbolzrastra; 36;RS_85;16MNU;": ("semicolons", "MNU", None, "RS_85", None, None),
        "@W a;symbolzrastra;oznaczenieterenuzrastra;1;12;3U": ("semicolons", "12", None, ops.UNNAMED["semicolons"], None, None),
        "@W symbolzrastra;numeruchwałyouchwaleniuplanu;MN;X/1;": ("semicolons", "MN", None, ops.UNNAMED["semicolons"], "X/1", None),
        "@W a;b;c": None,
        "@W a;b;1;2": None,
        "@bez;spacji;": None,
        "<b>Przeznaczenie:</b> <b> 16MNU </b> - mieszkaniowa\n<b>Legenda:</b> <a href='https://l'>x</a><b>Nazwa:</b><strong>P <i>1</i></strong> MPZP Nr: X/2<br>": ("popup", "MNU", "mieszkaniowa", "P 1", "X/2", "https://l"),
        "<b>Przeznaczenie:</b> <b>U</b> - usługi<br/><br/><b>ZL</b> - las": ("popup", "U", "usługi", ops.UNNAMED["popup"], None, None),
        "<b>Przeznaczenie:</b> brak": None,
        "": None,
        None: None,
    }
    keys = list(answers)
    got = {keys[r.id]: (r.form, r.designation, r.description, r.plan_name, r.resolution, r.legend_url) for r in ops.point_hits(spark.createDataFrame(list(enumerate(keys)), "id int, body string")).collect()}
    assert got == {k: v for k, v in answers.items() if v}


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAGE)
    assert ops.plan_register(none).count() == ops.sheet_links(none).count() == ops.legend_entries(none).count() == 0


def test_an_answer_is_cut_once(spark):
    plan = ops.point_hits(spark.createDataFrame([(1, "x")], "id long, body string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Przeznaczenie") == 1 and plan.count("split(") == 2  # nothing is inlined where its value is only asked for


def test_rows_of_a_sheet_are_cut_once(spark):
    plan = ops.legend_entries(spark.createDataFrame([(1, "https://plan.test/", "<tr></tr>")], "source_id long, source_url string, body string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)<tr") == 1
