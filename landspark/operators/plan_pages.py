"""Plan registers, legends and answers of map services, from pages and texts to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspark.functions import markup
from landspark.functions.places import bound
from landspark.functions.text import html_to_text
from landspark.operators.backlog import resolve_href

# fixed values: cells of a register's row, and the cells of code, name, legend, application, picture and map
ROW_CELLS, CODE, NAME, LEGEND, APPLICATION, PICTURE, MAP = 13, 0, 1, 7, 8, 10, 12
# fixed values: parts of keys that name a designation or a plan, words that are no designation, what a legend's heading begins with
DESIGNATION_KEYS, PLAN_KEYS = ("oznacz", "symbol", "przezn", "stref"), ("plan", "uchwal")
NO_DESIGNATION = ("GETFEATUREINFO", "SPATIALPLAN", "INSPIREID", "EXTENT", "OFFICIALTITLE")
HEADING, HEADING_FOR, HEADING_ROWS = "LEGENDA", "dla ", 6
# fixed values: keys of a point's answer, and the names of plans that answers leave out
POINT_KEYS = {"designation": ("symbolzrastra", "oznaczenieterenuzrastra"), "plan_name": "numerplanu", "description": "kategoriaprzeznaczeniaterenu", "resolution": "numeruchwałyouchwaleniuplanu"}
UNNAMED = {"semicolons": "Ruda Śląska WMS", "popup": "GISON MPZP"}
TOKEN = r"(?<![\p{L}\d_])(\d{0,3}[A-Z]{1,6}(?:[-/.][A-Z0-9]{1,6})*)(?![\p{L}\d_])"


def designation(value: Column) -> Column:
    """A designation without its number and punctuation; null of nothing and of words that are none."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.regexp_replace(value, r"\s+", " "))), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", ""), r"^\d+", "")
    return F.when((bare != "") & ~bare.isin(*NO_DESIGNATION), bare)


def token(text: Column) -> Column:
    """The first token of a text that can be a designation."""
    return designation(F.nullif(F.regexp_extract(F.upper(text), TOKEN, 1), F.lit("")))


def plan_register(pages: DataFrame) -> DataFrame:
    """Plans of register pages (source_id, source_url, body): plan_code, name, links, service and box of each row of enough cells.

    legend_url, app_url, picture_url and map_url are whole addresses; wms_url and the box (minx, miny, maxx, maxy; null unless it has
    four numbers) come from the map's query string; area_code are the six digits of the service's path.  Rows without a code, and
    null or empty pages, give none.
    """
    row = pages.select("source_id", "source_url", F.posexplode(markup.rows(F.col("body"), "mpzp")).alias("row", "x")).withColumn("c", markup.cells(F.col("x"))).filter(F.size("c") >= ROW_CELLS)
    link = lambda k: resolve_href(F.col("source_url"), F.get("c", F.lit(k)))
    row = row.select("source_id", "source_url", "row", html_to_text(F.get("c", F.lit(CODE))).alias("plan_code"), html_to_text(F.get("c", F.lit(NAME))).alias("name"), link(LEGEND).alias("legend_url"), link(APPLICATION).alias("app_url"), link(PICTURE).alias("picture_url"), link(MAP).alias("map_url"))
    row = row.filter("plan_code <> ''")
    # by an expression: parse_url knows no address with a space in it
    query = lambda key: F.try_url_decode(F.nullif(F.regexp_extract("map_url", rf"[?&]{key}=([^&#]*)", 1), F.lit("")))
    row = row.withColumn("_box", F.transform(F.split(query("bbox"), ","), lambda x: F.trim(x).try_cast("double"))).withColumn("_service", query("resources"))
    row = row.withColumn("_box", F.when((F.size("_box") == 4) & ~F.exists("_box", lambda x: x.isNull()), F.col("_box")))
    row = row.withColumn("wms_url", F.when(F.contains("_service", F.lit("map:wms@")), F.try_url_decode(F.substring_index("_service", "map:wms@", -1))))
    code = F.coalesce(F.nullif(F.regexp_extract("wms_url", r"/plany/(\d{6})/(?:studium|\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("wms_url", r"/cgi-bin/(\d{6})", 1), F.lit("")))
    return row.withColumn("area_code", code).select("*", *(F.get("_box", F.lit(k)).alias(n) for k, n in enumerate(("minx", "miny", "maxx", "maxy")))).drop("_box", "_service")


def sheet_links(documents: DataFrame) -> DataFrame:
    """(source_id, sheet_url, i) of a legend document's sheets, each once, in order: those of its links, else of any reference to one."""
    tags = F.filter(F.split(F.coalesce("body", F.lit("")), "(?i)(?=<link)"), lambda x: F.lower(x).startswith("<link"))
    linked = F.filter(F.flatten(F.transform(tags, lambda x: markup.attributes(F.concat(F.substring_index(x, ">", 1), F.lit(">")), "href"))), lambda h: F.contains(F.lower(h), F.lit("sheet")))
    named = F.filter(markup.attributes(F.col("body"), "href"), lambda h: F.lower(h).rlike(r"sheet\d+\.html?$"))
    found = F.when(F.size(linked) > 0, linked).otherwise(named)
    rows = documents.select("source_id", "source_url", F.posexplode(F.array_distinct(found)).alias("i", "href"))
    return rows.select("source_id", resolve_href(F.col("source_url"), F.concat(F.lit("href='"), F.col("href"), F.lit("'"))).alias("sheet_url"), "i")


def legend_entries(sheets: DataFrame) -> DataFrame:
    """Entries of legend sheets (source_id, source_url, body): title, image_url, label and designation, each image and label once.

    A row's label is its longest cell (the first of equals) that is no heading; rows without a picture or a label are none.  The title
    is the first text of the first rows that is not the word for a legend.
    """
    rows = sheets.withColumn("_rows", markup.rows(F.col("body")))
    heads = F.filter(F.transform(F.slice("_rows", 1, HEADING_ROWS), lambda r: html_to_text(F.concat(F.lit("<tr"), r))), lambda x: (x != "") & (F.upper(x) != HEADING))
    title = F.regexp_replace(F.get(heads, F.lit(0)), f"^{HEADING_FOR}", "")
    rows = rows.select("source_id", "source_url", F.trim(title).alias("title"), F.posexplode(F.slice("_rows", 1, markup.MANY)).alias("row", "x"))
    texts = F.filter(F.transform(markup.cells(F.col("x")), html_to_text), lambda t: (t != "") & ~F.startswith(t, F.lit(HEADING)) & ~F.startswith(t, F.lit(HEADING_FOR)))
    longest = F.array_max(F.transform(texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]
    rows = rows.withColumn("label", longest).filter("label IS NOT NULL").select("*", F.posexplode(markup.attributes(F.col("x"), "src")).alias("k", "src")).filter("trim(src) <> ''")
    rows = rows.withColumn("image_url", resolve_href(F.col("source_url"), F.concat(F.lit("href='"), F.col("src"), F.lit("'"))))
    first = rows.groupBy("source_id", "source_url", "title", "image_url", "label").agg(F.min(F.struct("row", "k")).alias("_at"))
    return first.select("source_id", "source_url", "title", "image_url", "label", token(F.col("label")).alias("designation"))


def feature_hints(rows: DataFrame) -> DataFrame:
    """``rows`` (attributes: map, raw_text) with designation_hint and plan_name_hint.

    Attributes go before keys and values in the text (pieces at semicolons and line ends, cut at the first colon or equals sign), and
    these before the first token of the text that can be a designation; in each, the first that says something.  Null inputs say nothing.
    """
    entry = lambda k, v: F.struct(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "").alias("k"), F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s+", " ")).alias("v"))
    given = F.transform(F.map_entries("attributes"), lambda e: entry(e["key"], e["value"]))
    parts = F.filter(F.split("raw_text", "[;\n\r]"), lambda x: x.rlike(r"^\s*[\p{L}\d _./-]{2,}\s*[:=]"))
    told = F.transform(parts, lambda x: entry(F.regexp_extract(x, "^([^:=]*)[:=]", 1), F.regexp_replace(x, "^[^:=]*[:=]", "")))
    none = F.array().cast("array<struct<k: string, v: string>>")
    entries = F.filter(F.concat(F.coalesce(given, none), F.coalesce(told, none)), lambda e: e["v"] != "")
    says = lambda keys: F.filter("_entries", lambda e: e["k"].rlike("|".join(keys)))
    coded = F.array_compact(F.transform(says(DESIGNATION_KEYS), lambda e: designation(e["v"])))
    out = rows.withColumn("_entries", entries)
    return out.withColumn("designation_hint", F.coalesce(F.get(coded, F.lit(0)), token(F.col("raw_text")))).withColumn("plan_name_hint", F.get(says(PLAN_KEYS), F.lit(0))["v"]).drop("_entries")


def point_hits(answers: DataFrame) -> DataFrame:
    """Answers of map services for points (id, body) to form, designation, description, plan_name, resolution and legend_url.

    Two forms: ``@layer key;key;...;value;value;``, and a popup with headings in bold.  Answers that name no designation have no row.
    """
    answers_text = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " "))
    text = F.col("_text")
    head = F.substring_index(text, ";", 1)
    keyed = F.startswith(text, F.lit("@")) & F.contains(text, F.lit(";")) & F.trim(F.substr(head, F.lit(2))).contains(" ")
    stream = F.concat(F.element_at(F.split(head, " "), -1), F.substr(text, F.length(head) + 1))
    tokens = F.filter(F.transform(F.split(stream, ";"), lambda x: F.trim(x)), lambda x: x != "")
    rows = answers.withColumn("_text", answers_text).withColumn("_keyed", keyed).withColumn("_tokens", F.when(F.col("_keyed"), tokens)).withColumn("_n", F.size("_tokens"))
    half = (F.col("_n") / 2).cast("int")
    value = lambda key: bound(F.get(F.slice("_tokens", half + 1, half), F.array_position(F.slice("_tokens", 1, half), key).cast("int") - 1), lambda v: F.when(v != "", v))
    # values are bound: each is asked whether it is empty before it is used, and inside a lambda Spark would make it again each time
    some = lambda x: bound(x, lambda v: F.when(v != "", v))
    read = lambda x: some(html_to_text(x))
    bare = lambda x: bound(F.upper(F.trim(x)), lambda v: F.coalesce(some(F.regexp_replace(v, r"^\d+", "")), F.when(v != "", v)))
    first, second = POINT_KEYS["designation"]
    even = (F.col("_n") >= 2) & (F.col("_n") % 2 == 0)
    semicolons = F.when(
        even,
        F.struct(
            F.lit("semicolons").alias("form"), F.coalesce(bare(value(first)), bare(value(second))).alias("designation"), value(POINT_KEYS["description"]).alias("description"),
            F.coalesce(value(POINT_KEYS["plan_name"]), F.lit(UNNAMED["semicolons"])).alias("plan_name"), value(POINT_KEYS["resolution"]).alias("resolution"), F.lit(None).cast("string").alias("legend_url"),
        ),
    )
    # a popup: what stands between one bold heading with a colon and the next
    after = lambda heading: F.substring_index(F.regexp_replace(F.regexp_extract("body", rf"(?is)<b>\s*{heading}:\s*</b>(.*)", 1), r"(?is)<b>[^<]*:\s*</b>", "\x01"), "\x01", 1)
    land = F.regexp_replace(after("Przeznaczenie"), r"(?is)<br/><br/>.*", "")

    def popup(land: Column) -> Column:
        of = lambda designation: F.struct(
            F.lit("popup").alias("form"), designation.alias("designation"), read(F.regexp_extract(land, r"(?is)</b>\s*-\s*([^<\r\n]+)", 1)).alias("description"),
            F.coalesce(read(F.regexp_extract(after("Nazwa"), "(?is)<strong>(.*?)</strong>", 1)), F.lit(UNNAMED["popup"])).alias("plan_name"), read(F.regexp_extract("body", r"(?i)MPZP Nr:\s*([^<]+)", 1)).alias("resolution"),
            F.get(markup.attributes(after("Legenda"), "href"), F.lit(0)).alias("legend_url"),
        )
        # nothing else is read of an answer without a designation
        return bound(bare(read(F.regexp_extract(land, r"(?is)<b>([^<]+)</b>\s*-", 1))), lambda d: F.when(d.isNotNull(), of(d)))

    # a generator, not a filter: that would move below the steps and do them again
    answer = F.when(F.col("_keyed"), semicolons).otherwise(bound(land, popup))
    return rows.select(*(c for c in answers.columns if c != "body"), F.explode(F.filter(F.array(answer), lambda s: s["designation"].isNotNull())).alias("s")).select(*(c for c in answers.columns if c != "body"), "s.*")
