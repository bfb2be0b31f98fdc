"""HTML extraction: expected layouts, and all visible words against a plain parser."""

from html.parser import HTMLParser

import pytest

from landspark.llm import html_text

CASES = {
    "<p>a<p>b <b>c</b>d": "a\n\nb cd",
    "x<div>y</div>z": "x\ny\nz",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>one<li>two<ol><li>in<li>ner</ol><li>three</ul>after": "- one\n- two\n  1. in\n  2. ner\n- three\n\nafter",
    "<ol start=9><li>a<li>b</ol>": "9. a\n10. b",
    "<pre>\n a\n   b</pre>c": " a\n   b\n\nc",
    "<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>": "name       n\nlong name  1\nx          22",
    "<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>": "wide cell  z\na  b       c",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>": "a     b\n\ni  j",
    "<title>t</title><script>var a='</p>'</script><style>p{}</style>v": "v",
    "<p hidden>no<p style='color:red; display: none'>no<p>yes": "yes",
    "a &amp; b&nbsp;c &lt;": "a & b c <",
    "<!-- <p>x -->y<!-->z": "yz",
    "<a title='>'>k</a><b \"x>m": "km",
    "<div><span>unclosed": "unclosed",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<img alt='pic'> t<hr>u": "pic t\n\nu",
    "": "",
    "   ": "",
    "</p></div>x": "x",
    "a < b": "a < b",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert html_text.page_text(page) == CASES[page]


class Words(HTMLParser):
    """The visible words of well-formed pages, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.seen = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style") or tag in self.BREAKS:
            self.off += tag in ("head", "script", "style")
            self.seen.append(" ")

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style"):
            self.off -= 1
        if tag in self.BREAKS:
            self.seen.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.seen.append(data)

    BREAKS = html_text.BLOCKS | {"br", "td", "th", "tr"}


def test_all_visible_words_stay(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        plain = Words()
        plain.feed(r.html)
        plain.close()
        words = [w for w in got[r.page_id].split() if w != "-" and not w.rstrip(".").isdigit()]
        assert words == [w for w in "".join(plain.seen).split() if w != "-" and not w.rstrip(".").isdigit()], r.page_id


def test_edges(spark):
    deep = "<div>" * 60_000 + "deep" + "</div>" * 60_000
    rows = [(1, None), (2, ""), (3, deep), (3, deep), (4, "w " * 300_000), (None, "<p>n")]
    df = spark.createDataFrame([(i, h, "u", "t") for i, h in rows], "page_id long, html string, url string, text string")
    got = sorted(((r.page_id or 0, r.text) for r in html_text.extract_text(df).collect()))
    assert [x for x in got if x[0] < 4] == [(0, "n"), (1, ""), (2, ""), (3, "deep"), (3, "deep")]
    assert got[-1][1] == ("w " * 300_000).strip()
    assert html_text.extract_text(df.limit(0)).count() == 0
