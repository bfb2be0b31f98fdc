"""Parsing of Polish notices as column expressions: numbers, prices, land registers, dates, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landspark.functions import places

# fixed values: code of each province by its plain name
PROVINCE_CODES = {
    "dolnoslaskie": "02", "kujawsko-pomorskie": "04", "lubelskie": "06", "lubuskie": "08", "lodzkie": "10", "malopolskie": "12", "mazowieckie": "14", "opolskie": "16", "podkarpackie": "18",
    "podlaskie": "20", "pomorskie": "22", "slaskie": "24", "swietokrzyskie": "26", "warminsko-mazurskie": "28", "wielkopolskie": "30", "zachodniopomorskie": "32",
}
# fixed values: court codes of land registers
COURTS = (
    "WA1M", "WA2M", "WA3M", "WA4M", "WA5M", "WA1W", "WA2W", "KR1K", "KR2K", "KR1P", "KR1S", "KR1W", "KR1Y", "KR1E", "NS1S", "NS1N", "TR1T", "TR1N", "BB1O",
    "PO1P", "PO2P", "PO1N", "GD1G", "GD2G", "GD4K", "WR1K", "WR1F", "WR1W", "LD2K", "LD1G", "LD1Z", "GL1K", "GL1G", "GL1Z", "GL1B", "GL1C", "GL1R", "GL1T",
    "KA1K", "KA1C", "KA1L", "CZ1C", "CZ1O", "BB1B", "BB1Z", "SO1S", "SO1M", "BY1K", "WZ1K", "LU1I", "SZ1S", "BY1B",
)
WEIGHTS = (1, 3, 7)
#: Characters that stand for a space or a Polish letter, and what they are folded to, one for one, so that places stay.
FOLDED = ("\u00a0\u202f\u2007\u2009\n\t\rąćęłńóśźż", "       acelnoszz")
def amount(units: str) -> str:
    """An expression for a number and a unit behind it, in a folded text."""
    return rf"(?<!\d)(\d[\d\s.,]*\d|\d)(\s*(?:{units})(?!\w))"


# fixed values: phrases that introduce a price, the surest first, and what may stand between them and it (folded)
INTRODUCTIONS = (
    ("cena wywolania", "cena wywolawcza"),
    ("suma oszacowania", "wartosc oszacowania", "wartosci oszacowania", r"oszacowan\w* na"),
    ("za cene nie nizsza niz", "cena nabycia", "cena sprzedazy"),
    (r"(?:stanowiac|wynosz)\w*\D{0,24}(?:3/4|trzy czwarte)\D{0,24}oszacowania",),
)
GAP = r"\D{0,48}?(?:kwote)?\s*"
# fixed values: words near an amount that say it is no price (folded), and how many characters before and behind count
OTHER_AMOUNTS = ("najnizsze postapienie", "wadium", "rekojmia", "udzial", "ulamek", "zaliczk", "koszt")
BEFORE, BEHIND = 36, 20
#: Amounts before one that its surroundings may hold.
NEIGHBOURS = 60


def fold(text: Column) -> Column:
    """Lower case without Polish diacritics; every character stays one character in its place."""
    return F.translate(F.lower(text), *FOLDED)


def parse_decimal(text: Column) -> Column:
    """A number with Polish or English separators.

    The last separator is the decimal one if one or two digits follow it, or if both kinds occur; all others group digits.
    """

    def read(parts: Column) -> Column:
        bare, tail, whole = parts["bare"], parts["tail"], parts["whole"]
        both = F.contains(bare, F.lit(",")) & F.contains(bare, F.lit("."))
        point = both | F.length(tail).between(1, 2)
        with_point = F.concat(F.left(whole, F.length(whole) - F.length(tail)), F.lit("."), tail)
        return F.when(point, with_point).otherwise(whole).try_cast("decimal(18,2)")

    # bound, for inside a lambda each mention is evaluated anew
    parts = lambda bare: F.struct(bare.alias("bare"), F.regexp_extract(bare, r"[.,]([^.,]*)$", 1).alias("tail"), F.translate(bare, ".,", "").alias("whole"))
    return places.bound(F.regexp_replace(text, r"[^0-9,.\-]", ""), lambda bare: places.bound(parts(bare), read))


def sane_price(value: Column) -> Column:
    return places.bound(value, lambda v: F.when(v.between(1000, 100_000_000), v))


def extract_price(text: Column) -> Column:
    """The price a notice names: the first amount behind an introduction, in order of sureness, else the first that no other word claims.

    Introductions are looked for one after the other, and only a text without any is cut into amounts and their surroundings.
    """
    return places.bound(fold(text), priced)


def priced(plain: Column) -> Column:
    """The price that a folded text names."""
    first = lambda values: F.get(F.filter(F.transform(values, lambda x: sane_price(parse_decimal(x))), lambda v: v.isNotNull()), F.lit(0))
    introduced = [first(F.regexp_extract_all(plain, F.lit("(?:" + "|".join(x.replace(" ", r"\s+") for x in phrases) + ")" + GAP + amount("zl|pln")), 1)) for phrases in INTRODUCTIONS]
    return F.coalesce(*introduced, unclaimed_price(plain))


def unclaimed_price(plain: Column) -> Column:
    """The first amount of a folded text whose surroundings do not say that it is another one's."""
    # cut before each amount: a piece is the amount, its unit and the text up to the next amount
    pieces = F.split(F.regexp_replace(F.translate(plain, "\x01\x02\x03", ""), amount("zl|pln"), "\x01$1\x02$2\x03"), "\x01")

    def judge(bare: Column, piece: Column, i: Column) -> Column:
        before = F.right(F.array_join(F.slice(bare, F.greatest(i - NEIGHBOURS + 1, F.lit(1)), F.least(i, F.lit(NEIGHBOURS))), ""), F.lit(BEFORE))
        behind = F.left(F.concat(F.substring_index(piece, "\x03", -1), F.array_join(F.slice(bare, i + 2, BEHIND), "")), F.lit(BEHIND))
        value = sane_price(parse_decimal(F.substring_index(piece, "\x02", 1)))
        return F.when((i > 0) & ~F.concat(before, F.lit(" "), behind).rlike("|".join(OTHER_AMOUNTS)), value)

    def whole(x: Column) -> Column:
        judged = F.transform(x["pieces"], lambda piece, i: judge(x["plain"], piece, i))
        return F.get(F.filter(judged, lambda v: v.isNotNull()), F.lit(0))

    # arrays that a lambda names are made anew for each element unless they are bound, as the one element of an array
    bound = F.transform(F.array(pieces), lambda x: F.struct(x.alias("pieces"), F.transform(x, lambda y: F.translate(y, "\x02\x03", "")).alias("plain")))
    return F.get(F.transform(bound, whole), F.lit(0))


def check_digit(court: Column, number: Column) -> Column:
    """Check digit of a land register: letters count 10 to 35 as two digits, weights 1, 3, 7 in turn, modulo ten."""
    spread = F.transform(F.split(F.upper(court), ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    digits = F.filter(F.split(F.concat(F.array_join(spread, ""), number), ""), lambda d: d != "")
    weighed = F.transform(digits, lambda d, i: d.cast("int") * F.when(i % 3 == 0, WEIGHTS[0]).when(i % 3 == 1, WEIGHTS[1]).otherwise(WEIGHTS[2]))
    return F.aggregate(weighed, F.lit(0), lambda a, w: a + w) % 10


def extract_case(text: Column) -> Column:
    number = F.regexp_extract(text, r"(?i)\bKm([pP]?)\s+(\d{1,5}/\d{2,4})\b", 2)
    prefix = F.when(F.lower(F.regexp_extract(text, r"(?i)\bKm([pP]?)\s+(\d{1,5}/\d{2,4})\b", 1)) == "p", "Kmp ").otherwise("Km ")
    return F.when(number != "", F.concat(prefix, number))


def extract_area(text: Column) -> Column:
    """The first number of square metres that can be an area."""
    found = F.transform(F.regexp_extract_all(fold(text), F.lit(amount("m2|m²")), 1), parse_decimal)
    return F.get(F.filter(found, lambda v: v.between(0.5, 10_000_000)), F.lit(0))


def extract_date(text: Column) -> Column:
    """The first day.month.year of a text, with dots, dashes or strokes; null if it is no date."""
    found = F.regexp_extract(text, r"(?<!\d)\d{1,2}([./-])\d{1,2}[./-]\d{4}(?!\d)", 0)
    return F.when(found != "", F.try_to_date(F.translate(found, "/-", ".."), "d.M.yyyy"))


def extract_location(text: Column) -> Column:
    """Struct of gmina, powiat and province, each null where the text doesn't name it.

    A gmina is the run of capitals behind its word, a powiat the one or two words behind its own, and a province the word behind
    its own, or else the first word that is a province's.
    """
    # bound: asked whether it is empty, and searched for once
    named = lambda pattern: places.bound(F.regexp_extract(text, pattern, 1), lambda v: F.when(v != "", v))
    word = r"[\p{L}-]+"
    county = rf"{places.any_of('powiat')}\s+((?:{word} )?{word})(?=\s*(?:[,.;]|{places.any_of('woj*')}|$))"
    return F.struct(
        named(rf"{places.any_of('gmina', 'gm.')}\s+({places.NAME})").alias("gmina"),
        named(county).alias("powiat"),
        F.coalesce(named(rf"{places.any_of('woj.', 'wojewodztwo')}\s+({word})"), named(f"({places.any_of(*PROVINCE_CODES)})")).alias("province"),
    )


def ascii_key(text: Column) -> Column:
    """Key of a place name: lower case, no diacritics, hyphens and spaces as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ąćęłńóśźż", "acelnoszz"), r"[\s\-]+", " "))


# fixed values: inflected names (as keys) that no rule brings to the nominative
FORMS = {
    "bielsku bialej": "Bielsko-Biała", "brzeszczach": "Brzeszcze", "czestochowie": "Częstochowa", "dabrowie gorniczej": "Dąbrowa Górnicza", "grzegorzowicach wielkich": "Grzegorzowice Wielkie",
    "imielinie": "Imielin", "jelesni": "Jeleśnia", "nowym saczu": "Nowy Sącz", "rudzie slaskiej": "Ruda Śląska",
}
# fixed values: endings of one word, and of any name, that are a street's and no place's
GENITIVES, DATES = ("ego", "ej", "lecia"), ("stycznia", "maja", "wrzesnia", "listopada")


def nominative(name: Column, forms: dict[str, str] = FORMS) -> Column:
    """A place's name in the nominative; null if it is rather a street's, as it is if no rule knows it.

    A stray w behind a final vowel goes; then the table of ``forms`` (by key) decides, then -anem becomes -ane and -owie -ów.
    """
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv]) if forms else F.lit(None).cast("map<string,string>")

    def of(bare: Column, key: Column) -> Column:
        street = (~F.contains(key, F.lit(" ")) & key.rlike(f"(?:{'|'.join(GENITIVES)})$")) | key.rlike(f"(?:{'|'.join(DATES)})$")
        ruled = F.when(key.rlike("anem$"), F.left(bare, F.length(bare) - 1)).when(key.rlike("owie$"), F.concat(F.left(bare, F.length(bare) - 4), F.lit("ów"))).otherwise(bare)
        return F.coalesce(F.try_element_at(table, key), F.when(~street, ruled))

    bare = F.regexp_replace(F.trim(name), "(?i)(?<=[aeiyąę])w$", "")
    return places.bound(bare, lambda b: places.bound(ascii_key(b), lambda k: of(b, k)))


#: Named entities that pages use, in the order in which they are replaced; the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_to_text(page: Column) -> Column:
    """Tags become spaces, entities their characters, white space collapses; scripts and styles go."""
    out = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
