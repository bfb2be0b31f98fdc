"""Layout-aware text of HTML pages.

A tree builder closes elements that HTML lets authors leave open, visibility rules drop what a browser would not show,
and a renderer walks the tree: blocks stand on lines of their own with blank lines where browsers put margins, lists keep
their bullets, numbers and nesting, preformatted text keeps its spaces, and the cells of a table stand in aligned columns.
Nothing visible is dropped: navigation and footers stay.

Depth is shown within bounds, so that the text grows with the page: a line is indented by ``INDENT`` columns at most, a
column of a table counts ``WIDEST`` characters at most for alignment (longer cells push what follows on their line), no cell
begins right of ``RIGHTMOST``, and in tables inside ``TABLES`` others cells stand below each other, each on its own lines.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bounds on how depth is shown.
INDENT, WIDEST, RIGHTMOST, TABLES = 40, 120, 1200, 6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object canvas audio video datalist".split())
#: Parts of drawings and formulas that are not shown, or only where others refer to them.
UNSEEN_FOREIGN = frozenset("desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml mphantom".split())
#: In these elements of drawings and formulas, HTML's own rules hold again.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Start tags that end a drawing or formula.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Parts of a formula whose children stand over or beside each other.
STACKED = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtable mtr".split())
#: Start tags that may stand in a head; any other one ends it.
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
BLANK = " \t\n\r\f"
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
#: Controls and choices within a line, with a space on both sides.
APART = frozenset("select option optgroup textarea".split())
#: A start tag closes these open elements, up to a boundary.
CLOSES = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag looks no further than this for its element.
SCOPE = frozenset({"table", "td", "th", "html"})

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z)) | <[!?][^>]*(?:>|\Z) | </([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)
    | <([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | <([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, foreign: bool = False):
        """``foreign``: it stands in a drawing or formula; afterwards, whether its children do."""
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.hidden = tag in UNSEEN or bool(attrs) and ("hidden" in attrs or bool(HIDES.search(attrs.get("style", "")))) or tag == "dialog" and "open" not in self.attrs
        if foreign and (tag in UNSEEN_FOREIGN or self.attrs.get("display", "").strip() == "none" or self.attrs.get("visibility", "").strip() in ("hidden", "collapse")):
            self.hidden = True
        self.foreign = tag in ("svg", "math") or foreign and tag not in INTEGRATION


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[:1] else value))
    return found


def ends_itself(body: str) -> bool:
    """Whether what follows a start tag's name ends in a slash of its own, not in an unquoted value's."""
    last = body.rsplit(None, 1)[-1] if body.endswith("/") else ""
    return bool(last) and ("=" not in last or last[-2] in "\"'")


def build(page: str) -> Node:
    """The tree of a page; implied end tags are put in, stray end tags are left out."""
    root = Node("html")
    stack, at, size = [root], 0, len(page)
    counts = {"html": 1}

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            counts[stack.pop().tag] -= 1

    def close(tags, limits) -> None:
        """Close the outermost open element of ``tags`` above the innermost of ``limits``."""
        if not any(counts.get(t) for t in tags):
            return
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in limits:
                break
            if stack[k].tag in tags:
                cut = k
        if cut is not None:
            pop_to(cut)

    def put(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(BLANK):
            pop_to(len(stack) - 1)
        stack[-1].children.append(text)

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            put(html.unescape(page[at:]))
            break
        if m.start() > at:
            text = page[at : m.start()]
            put(html.unescape(text) if "&" in text else text)
        at = m.end()
        if stack[-1].foreign and page.startswith("<![CDATA[", m.start()):
            end = page.find("]]>", m.start())
            end = size if end < 0 else end
            put(page[m.start() + 9 : end])
            at = min(end + 3, size)
            continue
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                if stack[-1].tag == "head":
                    pop_to(len(stack) - 1)
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not counts.get("p"):
                stack[-1].children.append(Node("p"))
            elif counts.get(tag) and tag != "html":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
                        break
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag or tag == "html":
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCKS and counts.get("p"):
            close({"p"}, SCOPE)
        if stack[-1].tag == "head" and tag not in HEAD:
            pop_to(len(stack) - 1)
        if tag in BREAKOUT:
            while stack[-1].foreign:
                pop_to(len(stack) - 1)
        body, foreign = m[3] or m[5] or "", stack[-1].foreign
        node = Node(tag, attributes(body) if "=" in body or body.strip(" /\t\n\r\f") else None, foreign)
        if foreign and stack[-1].tag in STACKED:
            stack[-1].children.append(" ")
        stack[-1].children.append(node)
        if tag in VOID and not foreign or (foreign or node.foreign) and ends_itself(body):
            continue
        if tag in RAW and (not foreign or tag in ("script", "style")):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text = page[at : end.start() if end else size]
            node.children.append(html.unescape(text) if tag == "textarea" else text)
            at = end.end() if end else size
        else:
            stack.append(node)
            counts[tag] = counts.get(tag, 0) + 1
    return root


class Block:
    """Lines that are being laid out, with a prefix for list items and quotes."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.margin, self.marker, self.indent = False, 0, "", 0

    def text(self, s: str) -> None:
        words = SPACES.sub(" ", s)
        if not words or words == " ":
            self.gap = self.gap or bool(words) and bool(self.parts)
            return
        if words[0] == " ":
            self.gap, words = self.gap or bool(self.parts), words[1:]
        tail = words[-1] == " "
        if self.gap and self.parts:
            self.parts.append(" ")
        self.parts.append(words[:-1] if tail else words)
        self.gap = tail

    def put(self, line: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.margin)
        self.margin = 0
        left = max(0, min(self.indent, INDENT) - len(self.marker))
        self.lines.append((" " * left + self.marker + line).rstrip(" "))
        self.marker = ""

    def end_line(self, margin: int = 0, forced: bool = False) -> None:
        if self.parts or forced:
            self.put("".join(self.parts))
            self.parts = []
        self.gap = False
        self.margin = max(self.margin, margin)


def span(attrs: dict[str, str], name: str) -> int:
    value = attrs.get(name, "1").strip()
    return min(int(value), 1000) if re.fullmatch(r"[0-9]{1,9}", value) and int(value) else 1


def lay_table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows) to lines with aligned columns, two spaces apart."""
    placed, taken = [], {}
    for r, row in enumerate(rows):
        c = 0
        for lines, wide, high in row:
            while taken.get(c, 0) > r:
                c += 1
            for k in range(c, c + wide):
                taken[k] = r + high
            placed.append((r, c, wide, lines))
            c += wide
    width: dict[int, int] = {}
    for r, c, wide, lines in sorted(placed, key=lambda x: x[2]):
        need = min(max(map(len, lines), default=0), WIDEST) - sum(width.get(k, 0) + 2 for k in range(c, c + wide - 1))
        width[c + wide - 1] = max(width.get(c + wide - 1, 0), need)
    used = sorted(width)
    left, place = {}, 0
    for k in used:
        left[k] = min(place, RIGHTMOST)
        place += width[k] + 2 if width[k] else 0

    def start(c: int) -> int:
        """A spanning cell begins where its first column that has a width does."""
        k = bisect.bisect_left(used, c)
        return left[used[k]] if k < len(used) else min(place, RIGHTMOST)

    out: list[str] = []
    by_row: dict[int, list] = {}
    for r, c, _, lines in placed:
        by_row.setdefault(r, []).append((start(c), lines))
    for r in range(len(rows)):
        cells = by_row.get(r, [])
        for k in range(max((len(x) for _, x in cells), default=0)):
            line = ""
            for at, lines in cells:
                if k < len(lines) and lines[k]:
                    line = (line.ljust(at) if len(line) + 2 <= at or not line else line + "  ") + lines[k]
            out.append(line.rstrip(" "))
    return out


def render(root: Node) -> str:
    """The visible text of a tree; walks with a stack of its own, so that depth is no limit."""
    blocks, tables, lists, pre, plain = [Block()], [], [], 0, 0  # plain: open tables whose cells stand below each other
    todo: list[tuple] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        out = blocks[-1]
        if isinstance(node, str):
            if pre:
                for k, line in enumerate(node.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                    if k:
                        out.end_line(forced=True)
                    if line:
                        out.parts.append(line)
            else:
                out.text(node)
            continue
        tag = node.tag
        if not leaving:
            if node.hidden:
                continue
            if tag == "br":
                out.end_line(forced=True)
                continue
            if tag == "hr":
                out.end_line(1)
                continue
            if tag == "img":
                if node.attrs.get("alt", "").strip():
                    out.text(node.attrs["alt"])
                continue
            if tag == "input" and node.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
                out.text(node.attrs.get("value", ""))
                continue
            if tag in VOID and not node.foreign:
                continue
            if tag in APART or tag == "text" and node.foreign:
                out.text(" ")
            if tag in ("option", "optgroup") and node.attrs.get("label", "").strip():
                out.text(node.attrs["label"] + (" " if tag == "optgroup" else ""))
                if tag == "option":  # its label is shown in place of its text
                    out.text(" ")
                    continue
            if tag in BLOCKS or plain and tag in ("tr", "td", "th"):
                out.end_line(1 if tag in MARGIN and not (tag in LISTS and lists) else 0)
            if tag in LISTS:
                first = node.attrs.get("start", "1").strip()
                lists.append([tag == "ol", int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1])
            elif tag == "li":
                marker = "- "
                if lists and lists[-1][0]:
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                out.indent += len(marker)
                out.marker = (out.marker + marker) if out.marker else marker
                node.attrs["_"] = marker
            elif tag == "dd" or tag == "blockquote":
                out.indent += 2
            elif tag in ("pre", "textarea"):
                pre += 1
                if tag == "textarea" and out.gap:
                    out.parts.append(" ")
                    out.gap = False
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = re.sub(r"^\r?\n", "", node.children[0])
            elif tag == "table" and (plain or len(tables) >= TABLES):
                plain += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables and not plain:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and not plain:
                if not tables[-1]:
                    tables[-1].append([])
                blocks.append(Block())
            todo.append((node, True))
            todo.extend((x, False) for x in reversed(node.children))
            continue
        if plain and tag in ("table", "tr", "td", "th"):
            plain -= tag == "table"
            out.end_line(tag == "table")
        elif tag in ("td", "th") and tables:
            cell = blocks.pop()
            cell.end_line()
            lines = cell.lines
            tables[-1][-1].append((lines, span(node.attrs, "colspan"), span(node.attrs, "rowspan")))
        elif tag == "table":
            out.end_line(1)
            for line in lay_table(tables.pop()):
                out.put(line)
            out.end_line(1)
        elif tag in APART or tag == "text" and node.foreign:
            pre -= tag == "textarea"
            out.text(" ")
        elif tag in BLOCKS:
            if tag == "pre":
                pre -= 1
            out.end_line(1 if tag in MARGIN and not (tag in LISTS and len(lists) > 1) else 0)
            if tag in LISTS and lists:
                lists.pop()
            elif tag == "li":
                out.indent -= len(node.attrs["_"])
                out.marker = ""
            elif tag in ("dd", "blockquote"):
                out.indent -= 2
    blocks[0].end_line()
    return "\n".join(blocks[0].lines).strip("\n")


def page_text(page: str | None) -> str:
    return render(build(page.replace("\0", "�"))) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, text, n_chars, n_lines.

    Null and empty html give an empty text.  Rows that repeat an id are rendered each on its own; an empty table gives no
    rows; other columns are not read.  No size of page and no depth of nesting is too large: see the bounds above.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                texts = [page_text(x) for x in b.column(1).slice(at, 128).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 128).cast(pa.int64()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                    names=["page_id", "text", "n_chars", "n_lines"],
                )

    return pages.select(id_col, html_col).mapInArrow(extract, "page_id long, text string, n_chars long, n_lines long")
