"""Names of places in Polish notices as column expressions: phrases as data, matches with their positions, names as runs of capitals.

A phrase is written in plain lower-case letters and ``compiled`` to an expression that also finds it with Polish letters and in
capitals.  A name is not cut out of the words behind a phrase by what may follow it: it is the run of capitalised words that
begins there, up to the first word of another kind.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Polish letters by the plain one they are folded to
MARKED = {"a": "ą", "c": "ć", "e": "ę", "l": "ł", "n": "ń", "o": "ó", "s": "ś", "z": "źż"}
# fixed values: capitalised words of notices that are no part of a name, kinds of places before a name, and what is no place
OFFICE = ("komornik", "kancelaria", "sygnatura", "sygnatury", "obwieszczenie", "licytacja", "adres", "poczta", "opis", "dla", "kw", "nr", "dzialka", "dzialki", "nieruchomosc", "nieruchomosci")
KINDS = ("gmina", "gminie", "wies", "wsi", "miasto", "miasta", "miescie", "miejscowosc", "miejscowosci", "powiat", "powiecie")
NO_PLACES = ("licytacji", "drodze", "terenie", "granicy", "ksiedze", "ewidencji", "dzialce", "budowie", "wojewodztwie", *KINDS, *OFFICE)
# fixed values: endings of streets' names (adjectives, genitives and dates), and of declension
STREETS = ("ska", "cka", "dzka", "na", "wa", "ej", "ego", "ich", "ych", "lecia", "wrzesnia", "listopada", "stycznia", "maja", "kwietnia")
ENDINGS = ("owie", "owego", "owej", "owym", "ami", "ach", "ego", "emu", "owa", "owe", "owi", "ym", "ie", "u", "a", "y", "e")
#: Words of a name at most, letters of a name of one word at most.
LONGEST_RUN, LONGEST_WORD = 4, 20

#: Characters kept before and behind a match.
BEFORE, BEHIND = 30, 60
MARKS = "\x01\x02\x03\x04\x05"


def loose(word: str) -> str:
    """An expression for a plain word that takes marked letters too; ``*`` is any ending, ``.`` an optional full stop."""
    signs = {"*": r"\p{L}*", ".": r"\.?"}
    return "".join(signs.get(c) or (f"[{c}{MARKED[c]}]" if c in MARKED else c) for c in word)


def any_of(*phrases: str) -> str:
    """An expression for any of some phrases, in whatever case, as whole words."""
    return r"(?iu:(?<![\p{L}\d])(?:" + "|".join(r"\s+".join(map(loose, p.split())) for p in phrases) + r")(?!\p{L}))"


_WORD = rf"(?!{any_of(*OFFICE)})\p{{Lu}}\p{{L}}+(?:-\p{{Lu}}?\p{{L}}+)*"
#: A run of capitalised words, and one that a scan may have cut: a piece in small letters may stand at its end.
NAME = rf"{_WORD}(?: {_WORD}){{0,{LONGEST_RUN - 1}}}"
CUT_NAME = rf"{NAME}(?: \p{{Ll}}{{3,}}(?=\s*(?:,|$)|\s+\p{{Lu}}))?"


def plain(text: Column) -> Column:
    """Lower case without marks; every character stays one character."""
    return F.translate(F.lower(text), "".join(MARKED.values()), "".join(k * len(v) for k, v in MARKED.items()))


def folded(text: Column) -> Column:
    """The text with every character that an expression of ``loose`` takes for a plain letter as that letter; places may move."""
    return F.translate(F.lower(text), "".join(MARKED.values()) + "ſı\u0307", "".join(k * len(v) for k, v in MARKED.items()) + "si")


def holds_any(plain_text: Column, pieces: tuple[str, ...]) -> Column:
    """Whether a text holds one of some strings, which is much cheaper than a search for phrases that have them in common."""
    return functools.reduce(lambda a, b: a | b, (F.contains(plain_text, F.lit(x)) for x in pieces))


def matches(text: Column, lead: str, name: str, follow: str = "", surroundings: bool = False) -> Column:
    """All matches of ``lead`` and ``name`` with ``follow`` (a look-ahead) behind, from left to right, without overlaps.

    An array of structs (lead, name, before, behind, step), the first of which is the text before any match (``name`` null);
    ``step`` is the number of characters to the next one, so that running sums are positions.  The patterns hold no
    capturing groups.  ``surroundings`` fills ``before`` and ``behind``, which are empty otherwise.
    """
    back = rf"(?=(?:{lead})(?:{name}){follow})(?<=((?s:.{{{BEFORE}}})|^(?s:.{{0,{BEFORE - 1}}})))" if surroundings else "()"
    ahead = rf"(?=((?s:.{{0,{BEHIND}}})))" if surroundings else "()"
    marked = F.regexp_replace(F.translate(text, MARKS, " " * len(MARKS)), rf"{back}({lead})({name}){follow}{ahead}", "\x01$1\x02$2\x03$3\x04$4\x05")

    def piece(x: Column, i: Column) -> Column:
        part = lambda left, right: F.substring_index(F.substring_index(x, right, 1), left, -1)
        rest = F.substring_index(x, "\x05", -1)
        found = lambda c: F.when(i > 0, c)
        step = F.length(rest) + F.when(i > 0, F.length(part("\x02", "\x03")) + F.length(part("\x03", "\x04"))).otherwise(0)
        return F.struct(found(part("\x02", "\x03")).alias("lead"), found(part("\x03", "\x04")).alias("name"), found(F.substring_index(x, "\x02", 1)).alias("before"), found(part("\x04", "\x05")).alias("behind"), step.alias("step"))

    return F.transform(F.split(marked, "\x01"), piece)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tidy(run: Column) -> Column:
    """A run of capitals as a name: the kind of the place goes, a cut-off piece is joined, all capitals become a title.

    No Polish word has ``zcz`` behind a vowel, so where a cut joins such letters the ``s`` that was lost is put back.
    """
    text = F.regexp_replace(run, rf"^{any_of(*KINDS)}\s+", "")
    joined = F.regexp_replace(F.regexp_replace(text, r" (?=\p{Ll})", "\x01"), "(?<=[aąeęiouóy])\x01(?=zcz)", "s")
    title = lambda x: F.replace(F.initcap(F.replace(x, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))
    return bound(F.replace(joined, F.lit("\x01"), F.lit("")), lambda x: F.when(x == F.upper(x), title(x)).otherwise(x))


def is_name(name: Column) -> Column:
    """Whether a tidied run can be a place: not a word of the procedure alone, and not too long for one word."""
    first = F.substring_index(plain(name), " ", 1)
    return ~first.isin(*NO_PLACES) & (F.contains(name, F.lit(" ")) | (F.length(name) <= LONGEST_WORD))


def is_street(name: Column) -> Column:
    """Whether a name before a postcode is rather a street's."""
    return plain(name).rlike("(?:" + "|".join(STREETS) + ")$")


def names(run: Column) -> Column:
    """The place that a run of capitals names, as an array of one or none."""
    return F.filter(F.transform(F.array(run), tidy), is_name)


def stem(name: Column) -> Column:
    """The words of a name without their endings, so that its cases are one."""
    return F.regexp_replace(plain(name), rf"(?<!\S)(\S{{4,}}?)(?:{'|'.join(ENDINGS)})(?!\S)", "$1")
