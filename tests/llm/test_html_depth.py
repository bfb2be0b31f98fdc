"""Depth: all text stays, and the result grows with the page."""

import time

import pytest

from landspark.llm import html_text

SHAPES = {
    "list": ("<ul><li>w{} ", ""),
    "ordered": ("<ol><li>w{} ", ""),
    "quote": ("<blockquote>w{} ", ""),
    "division": ("<div>w{} ", "</div>"),
    "inline": ("<b>w{} ", "</b>"),
    "table": ("<table><tr><td>w{} <td>", "</table>"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_deep(shape):
    opening, closing = SHAPES[shape]
    sizes = []
    for n in (2000, 8000):
        page = "".join(opening.format(i) for i in range(n)) + closing * n
        began = time.time()
        text = html_text.page_text(page)
        assert time.time() - began < 30
        assert [w for w in text.split() if w[0] == "w"] == [f"w{i}" for i in range(n)]
        sizes.append(len(text))
    assert sizes[1] < 5 * sizes[0]


def test_wide_cells_push_but_do_not_pad():
    long = "x" * 50_000
    page = f"<table><tr><td>{long}<td>end" + "".join(f"<tr><td>a{i}<td>b{i}" for i in range(2000)) + "</table>"
    text = html_text.page_text(page)
    assert len(text) < 50_000 + 2000 * (html_text.WIDEST + 20)
    lines = text.split("\n")
    assert lines[0] == long + "  end" and lines[1].split() == ["a0", "b0"] and lines[1].index("b0") == html_text.WIDEST + 2
    page = "<table>" + "<tr><td colspan=900>a<td>b" * 500 + "</table>"
    assert len(html_text.page_text(page)) < 500 * (html_text.RIGHTMOST + 10)


def test_inner_tables_align_up_to_the_bound():
    assert html_text.page_text("<table><tr><td>a<td><table><tr><td>long<td>1<tr><td>x<td>2</table></table>") == "a  long  1\n   x     2"
