"""HTML extraction by layout: a tree with implied tags, visibility rules, and a rendering as plain text.

* Tree: end tags that may be left out are implied (head before text, body and any tag that may not stand in it, p before a block, li, dt, dd, option, rows and cells of tables), stray end tags are
  ignored, open elements end with the page. Elements deeper than DEEPEST become neighbours, as browsers do.
* Visibility: head, script, style and the like, the attribute `hidden`, hidden inputs, dialogs that are not open, and inline styles with
  display:none show nothing. visibility is inherited: hidden or collapse hides text down to an element that is visible again; a hidden cell
  of a table keeps its column.
* Rendering: white space collapses outside pre; br breaks a line; blocks begin on a new line, paragraphs, headings, lists and tables
  are set off by a blank line; list items carry a bullet or their number and are indented by level, up to INDENT characters; the cells of a
  table are padded to the width of their column, cells of several lines stand side by side.
* Bounds: lines of a cell beyond WIDE characters do not widen their column, and a table whose padding would be more than PAD times its own
  text is not padded at all; no text is lost by either. So a text is at most some PAD + INDENT times as long as its page. Comments, and a
  tag that the page ends in, are taken out beforehand in one pass, so that the parser never looks for the end of the same tag twice.

Defined cases: NULL and empty pages give an empty text. Text outside any element is shown. Repeated rows are rendered each; other
columns are not read; pages are never cut. Work stays in the task that reads the rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilframe.llm.common import per_text

DEEPEST = 256
#: Longest line of a cell that others are padded to; how much padding a table may have for each of its characters; deepest indentation; most columns of a span.
WIDE, PAD, INDENT, COLUMNS = 80, 8, 40, 1000

UNSEEN = set("head script style template noscript title meta link iframe canvas audio video datalist".split())
#: Not shown inside svg and math.
UNSEEN_IN = {"svg": set("defs symbol desc metadata clippath mask pattern marker".split()), "math": {"annotation", "annotation-xml"}}
UNSEEN_FOREIGN = set().union(*UNSEEN_IN.values())
SECTIONS = {"thead", "tbody", "tfoot", "colgroup"}
AROUND_ROWS = SECTIONS | {"table"}
#: Tags that leave an open head open.
IN_HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
BLANK = " \t\n\r\f"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr article section".split())
#: A start tag ends these open elements, looking up to the given borders.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}), "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
IMPLIED_END["thead"] = IMPLIED_END["tfoot"] = IMPLIED_END["tbody"]
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
_none = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_visibility = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_raw = "script style textarea title iframe noembed noframes xmp".split()
_mark = re.compile(rf"<!--|<({'|'.join(_raw)})(?=[\s/>])", re.I)
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _raw}
_comment_end = re.compile(r"--!?>")
_tag_begins = re.compile(r"<[A-Za-z/!?]")
_spaces = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """Puts start tags, end tags and text into a tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("html", {})]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            if tag == "body":
                self.leave_head()
            return
        if tag not in IN_HEAD:
            self.leave_head()
        if tag in ENDS_PARAGRAPH:
            self.end({"p"}, {"td", "th", "table", "li", "blockquote", "div"})
        if tag in IMPLIED_END:
            self.end(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.open[-1].tag in AROUND_ROWS:
            self.put(Node("tr", {}))
        if tag == "form" and self.open[-1].tag in AROUND_ROWS | {"tr"}:
            return  # rows and cells do not stand in it
        node = Node(tag, dict(attrs))
        if tag in UNSEEN_FOREIGN and any(tag in UNSEEN_IN.get(n.tag, ()) for n in self.open):
            node.attrs["hidden"] = None
        self.put(node)

    def put(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if node.tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def leave_head(self) -> None:
        """What may not stand in a head ends it."""
        if len(self.open) > 1 and self.open[-1].tag == "head":
            self.open.pop()

    def end(self, ended: set, border: set) -> None:
        """Close the outermost open element of these tags within the border, and all in it."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in border:
                return
            if self.open[k].tag in ended and not (k > 1 and self.open[k - 1].tag in ended):
                del self.open[k:]
                return

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if (tag not in BLOCKS or tag == "form") and self.open[k].tag in ("td", "th", "li", "table"):
                return

    def handle_data(self, data):
        if data.strip(BLANK):
            self.leave_head()
        self.open[-1].children.append(data)


def without_comments(html: str) -> str:
    """The page without comments and without a tag that never ends; what stands in script and the like is left alone."""
    last = html.rfind(">")
    if cut := _tag_begins.search(html, last + 1):
        html = html[: cut.start()]
    out, at = [], 0
    while mark := _mark.search(html, at):
        if tag := mark[1]:
            end = _raw_end[tag.lower()].search(html, mark.end())
            if not end:
                break
            inner = html[at : end.start()]
            if tag.lower() == "textarea":  # its tags are text
                begin = mark.start() + len(inner[mark.start() - at :].partition(">")[0]) + 1 - at
                inner = inner[:begin] + inner[begin:].replace("<", "&lt;")
            out.append(inner)
            at = end.start()
            continue
        out.append(html[at : mark.start()])
        if short := re.compile("-?>").match(html, mark.end()):
            at = short.end()
        elif end := _comment_end.search(html, mark.end()):
            at = end.end()
        else:
            return "".join(out)
    out.append(html[at:])
    return "".join(out)


def displayed(node: Node) -> bool:
    a = node.attrs
    return not (
        node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type") == "hidden") or (node.tag == "dialog" and "open" not in a)
        or _none.search(a.get("style") or "")
    )


def visible_part(node: Node, shown: bool = True) -> Node | None:
    """The tree without what is not displayed and without hidden text; None if nothing of an element is left that shows."""
    own = _visibility.findall(node.attrs.get("style") or "")
    shown = own[-1].lower() == "visible" if own else shown
    out = Node(node.tag, node.attrs)
    for child in node.children:
        if isinstance(child, str):
            if shown:
                out.children.append(child)
        elif displayed(child) and (part := visible_part(child, shown)):
            out.children.append(part)
    return out if shown or out.children or node.tag in ("td", "th") else None


class Lines:
    """Lines of a rendering: words flow into the last line, blank lines are asked for and never doubled."""

    def __init__(self):
        self.done: list[str] = []
        self.line = ""
        self.gap = 0  # 1: a new line is due, 2: a blank line

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *more = data.split("\n")
            self.put(first)
            for x in more:
                self.newline()
                self.put(x)
            return
        data = _spaces.sub(" ", data)
        if not self.line or self.gap or self.line.endswith(" "):
            data = data.lstrip(" ")
        if data:
            self.put(data)

    def put(self, data: str) -> None:
        if data:
            self.flush()
            self.line += data

    def flush(self) -> None:
        if self.gap:
            if self.line.strip():
                self.newline()
            self.line = ""
            if self.gap == 2 and self.done and self.done[-1]:
                self.done.append("")
            self.gap = 0

    def newline(self) -> None:
        self.done.append(self.line.rstrip())
        self.line = ""

    def block(self, spaced: bool) -> None:
        if self.line.strip() or self.done:
            self.gap = max(self.gap, 2 if spaced else 1)

    def lines(self) -> list[str]:
        out = [*self.done, self.line.rstrip()]
        while out and not out[-1]:
            out.pop()
        while out and not out[0]:
            out.pop(0)
        return out


def render(node: Node, pre: bool = False) -> list[str]:
    out = Lines()
    _fill(node, out, pre)
    return out.lines()


def _fill(node: Node, out: Lines, pre: bool) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child, pre)
        elif child.tag == "br":
            out.flush()
            out.newline()
        elif child.tag not in BLOCKS:
            _fill(child, out, pre or child.tag == "textarea")
        else:
            spaced = child.tag in SPACED
            out.block(spaced)
            _lines(out, _block(child, pre))
            out.block(spaced)


def _lines(out: Lines, lines: list[str]) -> None:
    for k, line in enumerate(lines):
        if k:
            out.newline()
            out.line = line
        else:
            out.put(line)


def _block(node: Node, pre: bool) -> list[str]:
    if node.tag in ("ul", "ol", "menu"):
        return _list(node, pre)
    if node.tag == "table":
        return _table(node, pre)
    if node.tag == "hr":
        return ["---"]
    inner = render(node, pre or node.tag == "pre")
    if node.tag in ("blockquote", "dd"):
        return [_indented("  ", x) if x else x for x in inner]
    return inner


def _indented(by: str, line: str) -> str:
    return line if line[:INDENT].isspace() and len(line) > INDENT else by + line


def _list(node: Node, pre: bool) -> list[str]:
    out: list[str] = []
    start = node.attrs.get("start") or ""
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            out += [x for x in (_spaces.sub(" ", child).strip(),) if x]
        else:
            if child.tag != "li":
                out += _block(child, pre)
                continue
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            inner = [x for x in render(child, pre) if x] or [""]
            out += [mark + x if not k else _indented(" " * len(mark), x) for k, x in enumerate(inner)]
    return [x.rstrip() for x in out]


def _rows(node: Node):
    """Rows, and the part of the table that they stand in."""
    for child in node.children:
        if isinstance(child, str):
            continue
        if child.tag == "tr":
            yield node, child
        elif child.tag in SECTIONS:
            yield from _rows(child)


def _loose(node: Node, pre: bool) -> list[str]:
    """What stands in a table or a part of it outside of its rows."""
    out: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            out += [x for x in (_spaces.sub(" ", child).strip(),) if x]
        elif child.tag in SECTIONS:
            out += _loose(child, pre)
        elif child.tag != "tr":
            one = Node("div", {})
            one.children.append(child)
            out += render(one, pre)
    return out


def _span(cell: Node, name: str) -> int:
    span = cell.attrs.get(name) or ""
    return int(span) if re.fullmatch(r"[0-9]{1,5}", span) else 1


def _table(node: Node, pre: bool) -> list[str]:
    out = _loose(node, pre)
    rows, part, taken = [], None, {}
    for group, row in _rows(node):
        if group is not part:
            part, taken = group, {}  # rows that cells from above still take, by column
        cells: dict[int, list[str]] = {}
        below = {k: n - 1 for k, n in taken.items() if n > 1}
        at = 0
        for c in row.children:
            if isinstance(c, str) and not c.strip():
                continue
            while at in taken:
                at += 1
            wide, high = (1, 1) if isinstance(c, str) else (_span(c, "colspan"), _span(c, "rowspan"))
            wide = max(1, min(wide, COLUMNS - at)) if wide < 1000 else 1
            if high != 1:
                below.update({at + k: high - 1 if high else 65534 for k in range(wide)})
            cells[at] = [_spaces.sub(" ", c).strip()] if isinstance(c, str) else render(c, pre)
            at += wide
        taken = below
        rows.append(cells)
    widths: dict[int, int] = {}
    for cells in rows:
        for k, cell in cells.items():
            widths[k] = max(widths.get(k, 0), int(any(cell)), max((len(x) for x in cell if len(x) <= WIDE), default=0))
    columns = [k for k in sorted(widths) if widths[k]]
    # what each column and all before it take
    upto = dict(zip(columns, accumulate(widths[k] + 2 for k in columns)))
    text = padded = 0
    for cells in rows:
        high = max(map(len, cells.values()), default=0)
        text += sum(len(x) + 2 for cell in cells.values() for x in cell)
        padded += high * max((upto[k] for k, cell in cells.items() if any(cell) and k in upto), default=0)
    aligned = padded <= (PAD + 1) * text
    for cells in rows:
        there = columns if aligned else [k for k in columns if any(cells.get(k, ()))]
        for n in range(max(map(len, cells.values()), default=0)):
            parts = [(cell[n] if n < len(cell := cells.get(k, [])) else "") for k in there]
            out.append("  ".join(p.ljust(widths[k]) if aligned else p for p, k in zip(parts, there)).rstrip())
    return out


def extract(html: str) -> str:
    """The visible text of a page."""
    builder = Builder()
    builder.feed(without_comments(html))
    builder.close()
    return "\n".join(render(visible_part(builder.open[0])))


FIELDS = [T.StructField("text", T.StringType())]


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and visible text of every page. No shuffle."""
    return per_text(pages, key, html, FIELDS, lambda texts: [[extract(t.decode()) for t in texts]])
