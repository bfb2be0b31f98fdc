"""Rows, cells, links and texts of pages as column expressions; pieces are cut at opening tags, nothing is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of a page that are looked at, at most so many that no page has more.
MANY = 1 << 30


def _opening(piece: Column) -> Column:
    return F.lower(F.substring_index(piece, ">", 1))


def _pieces(text: Column, tag: str) -> Column:
    return F.slice(F.split(F.coalesce(text, F.lit("")), rf"(?i)<{tag}(?=[\s>])"), 2, MANY)


def rows(page: Column, having: str = "") -> Column:
    """The table rows of a page, up to their end; with ``having``, those whose class holds the word."""
    found = _pieces(page, "tr")
    if having:
        found = F.filter(found, lambda x: _opening(x).rlike(rf"class\s*=\s*['\"][^'\"]*{having}"))
    return F.transform(found, lambda x: F.regexp_replace(x, r"(?is)</tr\s*>.*", ""))


def cells(row: Column, having: str = "") -> Column:
    """The insides of a row's cells."""
    found = _pieces(row, "td")
    if having:
        found = F.filter(found, lambda x: _opening(x).rlike(rf"class\s*=\s*['\"][^'\"]*{having}"))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "^[^>]*>", ""), r"(?is)</td\s*>.*", ""))


def attributes(fragment: Column, name: str) -> Column:
    """All values of an attribute, in order, with ampersands as characters."""
    return F.transform(F.regexp_extract_all(F.coalesce(fragment, F.lit("")), F.lit(rf"(?i)\b{name}\s*=\s*['\"]([^'\"]+)['\"]"), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
