"""HTML extraction: bounds of output and time, inherited visibility, and visible words against an independent walk."""

import random
import re
import time

import pytest

from veilframe.llm import html_layout
from veilframe.llm.html_layout import extract


def test_visibility_is_inherited():
    assert extract('<div style="visibility:hidden">a<p style="visibility:visible">b</p>c</div>') == "b"
    assert extract('<div style="display:none">a<p style="visibility:visible">b</p></div>x') == "x"
    assert extract('<table><tr><td>a<td style="visibility:hidden">no<td>c<tr><td>d<td>e<td>f</table>') == "a     c\nd  e  f"
    assert extract('<ul><li style="visibility:collapse">a<li>b</ul>') == "- b"
    assert extract("<dialog>a</dialog><dialog open>b</dialog>") == "b"
    assert extract('<p style="color:red;VISIBILITY : Hidden">a</p><p style="--visibility:hidden">b</p>') == "b"


def test_comments_and_unfinished_tags():
    assert extract("a<!-- x -->b<!-->c<!--->d<!-- <p>e --!>f") == "abcdf"
    assert extract("a<script>if (x) { '<!--' }</script>b<textarea><!-- shown --></textarea>") == "ab<!-- shown -->"
    assert extract("a<!-- never closed <p>b") == "a"
    assert extract("a <b>c</b> <a href='x") == "a c"
    assert extract("1 < 2 and <") == "1 < 2 and <"
    assert extract("<style><!-- p {} </style>x") == "x"


PAGES = {
    "one wide cell": lambda n: "<table>" + "<tr><td>a<td>b" * (n // 14) + f"<tr><td>{'w' * (n // 10)}<td>c</table>",
    "wide columns and narrow rows": lambda n: "<table><tr>" + f"<td>{'w' * 79}" * 999 + "<tr><td colspan=998>a<td>b" * (n // 26) + "</table>",
    "open comments": lambda n: "<!--" * (n // 4),
    "open tags": lambda n: "<a " * (n // 3),
    "instructions": lambda n: "<?" * (n // 2),
    "declarations": lambda n: "<![" * (n // 3),
    "end tags": lambda n: "</a" * (n // 3),
    "nested lists": lambda n: "<ul><li>x" * (n // 18) + "y<br>z" * (n // 12),
    "nested quotes": lambda n: "<blockquote>x<br>" * (n // 17),
    "spans": lambda n: "<table><tr>" + "<td colspan=999 rowspan=9>x" * (n // 27) + "</table>",
}


@pytest.mark.parametrize("name", PAGES)
def test_output_and_time_follow_the_page(name):
    page = PAGES[name](200_000)
    start = time.process_time()
    text = extract(page)
    assert time.process_time() - start < 8
    assert len(text) <= (html_layout.PAD + html_layout.INDENT) * len(page)


def test_no_text_of_a_table_is_lost():
    rng = random.Random(6)
    for _ in range(60):
        words = iter(range(10**6))
        rows, want = [], set()
        for _ in range(rng.randrange(1, 6)):
            cells = []
            for _ in range(rng.randrange(0, 5)):
                own = [f"w{next(words)}" + "x" * rng.choice([0, 3, 200]) for _ in range(rng.randrange(0, 3))]
                want.update(own)
                span = rng.choice(["", " colspan=2", " rowspan=2", " rowspan=0 colspan=700", " colspan=9"])
                cells.append(f"<td{span}>{rng.choice([' ', '<br>', '<p>']).join(own)}")
            rows.append("<tr>" + "".join(cells))
        assert set(extract("<table>" + "".join(rows) + "</table>").split()) == want


def test_visible_words_by_an_independent_walk():
    """Random trees; the words that show are found from the tree itself, not from its markup."""
    rng = random.Random(9)
    tags = ["div", "p", "span", "b", "ul", "li", "section", "h2", "em", "blockquote", "style", "noscript", "pre", "a", "dialog"]
    styles = ["", "", "", "", ' style="display: none"', ' style="visibility:hidden"', ' style="color:red; visibility: visible"', " hidden", " open"]
    number = iter(range(10**9))

    def tree(depth):
        out = []
        for _ in range(rng.randrange(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                out.append(f"w{next(number)}")
            else:
                out.append((rng.choice(tags), rng.choice(styles), tree(depth - 1)))
        return out

    def markup(nodes):
        return " ".join(n if isinstance(n, str) else f"<{n[0]}{n[1]}>{markup(n[2])}</{n[0]}>" for n in nodes)

    def words(nodes, shown):
        for n in nodes:
            if isinstance(n, str):
                if shown:
                    yield n
                continue
            tag, style, inner = n
            if tag in ("style", "noscript") or style == " hidden" or "none" in style or (tag == "dialog" and style != " open"):
                continue
            yield from words(inner, {"hidden": False, "visible": True}.get(next(iter(re.findall(r"visibility:\s*(\w+)", style)), ""), shown))

    def nests(nodes, open_p=False):
        """Whether a block stands in a p, or text in raw elements holds tags; the parser closes those differently."""
        for n in nodes:
            if not isinstance(n, str):
                if open_p and n[0] not in ("span", "b", "em", "a"):
                    return True
                if n[0] == "style" and any(not isinstance(x, str) for x in n[2]):
                    return True
                if nests(n[2], open_p or n[0] == "p") or (n[0] == "li" and any(not isinstance(x, str) for x in n[2])):
                    return True
        return False

    tried = 0
    while tried < 300:
        made = tree(4)
        if nests(made):
            continue
        tried += 1
        assert set(extract(markup(made)).replace("- ", " ").split()) - {"-"} == set(words(made, True)), markup(made)
