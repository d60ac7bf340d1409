"""Layout-aware text of HTML pages.

A tree builder closes what HTML lets authors leave open, visibility rules drop what a browser doesn't
show, and a renderer lays out the rest: blank lines around paragraphs and headings, one line for other
blocks, marks and indents for lists, aligned columns for tables, text as it stands in pre.

Defined results: null or blank html gives an empty text; unclosed and unmatched tags are repaired;
nesting may have any depth; repeated rows are rendered each; an empty table gives no
rows; other columns are ignored. All visible text is emitted, in document order except that the cells
of a table row stand side by side. Columns are aligned by the width that a terminal gives their characters. Cells with a
line of more than 200 places stand on lines of their own, columns that would start after place 1000 follow
two spaces after the one before: so padding never grows with the product of rows and widths.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
ENDS_P = BLOCK - set("body dd dt html legend li optgroup option".split()) | {"hr", "plaintext", "li", "dd", "dt"}
HIDDEN = set("audio base canvas datalist embed head iframe link meta noembed noframes noscript object param script source style template title track video".split())
ROWS, CELLS, GROUPS = {"tr"}, {"td", "th"}, {"thead", "tbody", "tfoot"}
HEADERS = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}

#: What an opening tag closes, and the elements past which it closes nothing.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": (CELLS, {"tr", "table"}),
    "th": (CELLS, {"tr", "table"}),
    "tr": (CELLS | ROWS, {"table"}),
    "thead": (CELLS | ROWS | GROUPS | {"caption", "colgroup"}, {"table"}),
    "tbody": (CELLS | ROWS | GROUPS | {"caption", "colgroup"}, {"table"}),
    "tfoot": (CELLS | ROWS | GROUPS | {"caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Builder(HTMLParser):
    """Builds the tree; self.open is the path from the root to the open element, self.at the places of each tag on it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.at: defaultdict[str, list[int]] = defaultdict(list)

    def _cut(self, place: int) -> None:
        for node in self.open[place:]:
            self.at[node.tag].pop()
        del self.open[place:]

    def _nearest(self, tags: set[str]) -> int:
        """The place of the innermost open element of the tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close(self, tags: set[str], until: set[str]) -> None:
        """Close the outermost open element of the tags that lies within the nearest of `until`."""
        low = self._nearest(until)
        places = (p[i] for t in tags if (p := self.at.get(t)) and (i := bisect_right(p, low)) < len(p))
        if place := min(places, default=0):
            self._cut(place)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.at[node.tag].append(len(self.open))
        self.open.append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and (tag == "html" or self.at.get("body")):
            return
        if self.open[-1].tag == "head" and tag not in HEADERS and tag != "head":
            self._cut(-1)
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "table", "button", "caption", "object"})
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.open[-1].tag):
            self._cut(-1)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in CELLS and self.open[-1].tag in GROUPS | {"table"}:
            self.handle_starttag("tr", [])
        if tag == "tr" and self.open[-1].tag == "table":
            self._push(Node("tbody"))
        node = Node(tag, dict(attrs))
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing on other than void elements

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        stop = set() if tag in {"html", "body", "table"} else CELLS | {"table"} if tag not in CELLS | ROWS | GROUPS | {"caption"} else {"table"}
        place = self._nearest({tag})
        if place and place >= self._nearest(stop):
            self._cut(place)
            return
        if tag == "p":
            self.open[-1].children.append(Node("p"))

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(-1)
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


#: Widest cell that a column is aligned to, and the last place of a line that a column can start at.
WIDEST, FARTHEST = 200, 1_000

#: A step of the layout: it yields the steps that it needs and gets their results.
Step = Generator["Step", Any, Any]


def _done(step: Step) -> Any:
    """The result of a step; those that wait for others are held on a stack of our own, so that nesting has no limit."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether the element has a box, and whether its own text is visible."""
    attrs = node.attrs
    style = {k.lower(): v.lower() for k, v in STYLE.findall(attrs.get("style") or "")}
    gone = node.tag in HIDDEN or "hidden" in attrs or style.get("display") == "none" or (node.tag == "dialog" and "open" not in attrs) or (node.tag == "input" and (attrs.get("type") or "").lower() == "hidden")
    seen = style.get("visibility", "visible" if visible else "hidden") not in ("hidden", "collapse")
    return not gone, seen


class Lines:
    """Lines of a block under construction; blank lines between blocks collapse to the most asked for."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0

    def text(self, text: str) -> None:
        self.inline.append(text)

    def end_line(self, gap: int = 0) -> None:
        line = re.sub(r"[ \t\n\r\f]+", " ", "".join(self.inline)).strip(" ")
        self.inline = []
        if line:
            self._add([line])
        self.gap = max(self.gap, gap)

    def _add(self, lines: list[str]) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.extend(lines)

    def block(self, lines: list[str], gap: int = 0) -> None:
        self.end_line(gap)
        if lines:
            self._add(lines)
        self.gap = max(self.gap, gap)


def _roman(n: int) -> str:
    out = ""
    for value, mark in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += mark * (n // value)
        n %= value
    return out


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(97 + rest) + out
    return out


def _whole(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", text) else default


def _mark(kind: str, n: int) -> str:
    if n > 0 and kind in ("a", "A", "i", "I") and n < 4000:
        mark = _letters(n) if kind in "aA" else _roman(n)
        return (mark.upper() if kind in "AI" else mark) + "."
    return f"{n}."


def _list(node: Node, visible: bool) -> Step:
    out, items = Lines(), [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
    backward = "reversed" in node.attrs
    number = _whole(node.attrs.get("start"), len(items) if backward else 1)
    for child in node.children:
        if not isinstance(child, Node) or child.tag != "li":
            yield from _laid(child, visible, out)
            continue
        number = _whole(child.attrs.get("value"), number)
        mark = _mark(node.attrs.get("type") or "1", number) if node.tag == "ol" else "-"
        number += -1 if backward else 1
        box, seen = _shown(child, visible)
        if box:
            lines = yield _lines(child.children, seen)
            if lines:
                out.block([f"{mark} {lines[0]}", *((" " * (len(mark) + 1) + line if line else "") for line in lines[1:])])
    out.end_line()
    return out.lines


def _cells(node: Node, visible: bool) -> Step:
    """Rows of cells (lines, columns, rows), the captions, and text that stands outside of cells."""
    rows, captions, loose = {"thead": [], "tbody": [], "tfoot": []}, [], Lines()

    def group(node: Node, visible: bool, kind: str) -> Step:
        for child in node.children:
            if not isinstance(child, Node):
                yield from _laid(child, visible, loose)
                continue
            box, seen = _shown(child, visible)
            if not box:
                continue
            if child.tag == "caption":
                captions.extend((yield _lines(child.children, seen)))
            elif child.tag in GROUPS:
                yield group(child, seen, child.tag)
            elif child.tag == "tr":
                row = []
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in CELLS:
                        shown, own = _shown(cell, seen)
                        if shown:
                            row.append(((yield _lines(cell.children, own)), min(max(_whole(cell.attrs.get("colspan"), 1), 1), 1000), min(max(_whole(cell.attrs.get("rowspan"), 1), 1), 1000)))
                    else:
                        yield from _laid(cell, seen, loose)
                rows[kind].append(row)
            elif child.tag != "colgroup":
                yield from _laid(child, seen, loose)

    yield group(node, visible, "tbody")
    loose.end_line()
    return rows["thead"] + rows["tbody"] + rows["tfoot"], captions, loose.lines


def _width(text: str) -> int:
    """Places that the text takes in a line: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _side_by_side(cells: list[tuple[int, list[str]]], starts: dict[int, int]) -> list[str]:
    out = []
    for i in range(max((len(lines) for _, lines in cells), default=0)):
        parts, at = [], 0
        for column, lines in cells:
            part = lines[i] if i < len(lines) else ""
            if part:
                gap = max(starts[column] - at, 2 if at else 0)
                parts += (" " * gap, part)
                at += gap + _width(part)
        out.append("".join(parts).rstrip())
    return out


def _table(node: Node, visible: bool) -> Step:
    rows, out, loose = yield _cells(node, visible)
    out = loose + out
    placed, taken, widths = [], {}, {}
    for cells in rows:
        column, line = 0, []
        for lines, across, down in cells:
            while taken.get(column, 0) > 0:
                column += 1
            width = max(map(_width, lines), default=0)
            line.append((column, lines, width > WIDEST))
            if across == 1 and width <= WIDEST:
                widths[column] = max(widths.get(column, 0), width)
            for c in range(column, column + across):
                widths.setdefault(c, 0)
                taken[c] = max(taken.get(c, 0), down)
            column += across
        placed.append(line)
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
    at, starts = 0, {}
    for c in sorted(widths):
        starts[c] = at if at <= FARTHEST else 0
        at += widths[c] + 2 if widths[c] else 0
    for line in placed:
        together: list[tuple[int, list[str]]] = []
        for column, lines, wide in line:
            if wide:
                out += _side_by_side(together, starts) + lines
                together = []
            else:
                together.append((column, lines))
        out += _side_by_side(together, starts)
    return out


def _pre(node: Node, visible: bool) -> Step:
    out = []
    for child in node.children:
        if isinstance(child, str):
            out.append(child if visible else "")
        else:
            box, seen = _shown(child, visible)
            if box:
                out.append("\n" if child.tag == "br" else (yield _pre(child, seen)))
    return "".join(out)


def _laid(child: Node | str, visible: bool, out: Lines) -> Step:
    """Lay out one child of a block; texts need no step of their own."""
    if not isinstance(child, str):
        yield _flow(child, visible, out)
    elif visible:
        out.text(child)


def _flow(child: Node, visible: bool, out: Lines) -> Step:
    box, seen = _shown(child, visible)
    if not box:
        return
    tag = child.tag
    if tag == "br":
        if out.inline and "".join(out.inline).strip():
            out.end_line()
        else:
            out.end_line(1)
    elif tag == "hr":
        out.end_line(1)
    elif tag == "input":
        if seen and (child.attrs.get("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
            out.text(" " + (child.attrs.get("value") or "") + " ")
    elif tag in ("pre", "listing", "xmp", "plaintext", "textarea"):
        text = yield _pre(child, seen)
        lines = [line.rstrip() for line in text.expandtabs().removeprefix("\n").split("\n")]
        while lines and not lines[-1]:
            lines.pop()
        out.block(lines, 1)
    elif tag in ("ul", "ol", "menu", "dir"):
        out.block((yield _list(child, seen)), 1)
    elif tag == "table":
        out.block((yield _table(child, seen)), 1)
    elif tag == "details" and "open" not in child.attrs:
        out.end_line()
        for c in child.children:
            if isinstance(c, Node) and c.tag == "summary":
                yield _flow(c, seen, out)
    elif tag in ("dd", "blockquote"):
        out.block(["  " + line if line else "" for line in (yield _lines(child.children, seen))], int(tag in SPACED))
    elif tag in BLOCK or tag in CELLS | ROWS | GROUPS:
        gap = int(tag in SPACED)
        out.end_line(gap)
        for c in child.children:
            yield from _laid(c, seen, out)
        out.end_line(gap)
    else:
        for c in child.children:
            yield from _laid(c, seen, out)


def _lines(children: list[Node | str], visible: bool) -> Step:
    out = Lines()
    for child in children:
        yield from _laid(child, visible, out)
    out.end_line()
    return out.lines


def render(html: str | None) -> str:
    """The visible text of a page."""
    return "\n".join(_done(_lines(parse(html).children, True))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                texts = [render(h.as_py()) for h in batch.column(1)]
                yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int64()), pa.array([len(t.split()) for t in texts], pa.int64())], names=["page_id", "text", "n_lines", "n_words"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string, n_lines long, n_words long")
