"""HTML extraction: a tree with implied tags, rendered to the text a reader sees."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style title template noscript iframe object video audio canvas datalist meta link base noembed "
             "noframes".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset form hr menu".split())
BLOCK = SPACED | set("address article aside body center dd details dialog div dt figcaption footer header html legend li main "
                     "nav optgroup option search section summary caption tr thead tbody tfoot td th".split())
#: An opening tag closes open tags of the first set, looking up to the nearest of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"})),
}
SCOPE = {"table", "td", "th", "caption", "button", "template"}
IN_HEAD = {"base", "link", "meta", "title", "style", "script", "template", "noscript", "head", "html"}

# Names and what follows them are never given back, so a tag is read once; only text with a later ``>`` is searched for tags.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?""", re.S)
UNENDED = re.compile(r"<[!?/]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    """The tree of a document, however broken: unclosed tags end where HTML implies it, stray end tags are ignored."""
    root = Node("html", {})
    open_ = [root]
    places: dict[str, list[int]] = {}  # where in ``open_`` each tag stands, so no search walks a deep stack

    def cut(at: int) -> None:
        while len(open_) > at:
            places[open_.pop().tag].pop()

    def nearest(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set[str], until: set[str]) -> None:
        """End the outermost open element of the given tags inside the nearest container."""
        limit = nearest(until)
        inside = [own[i] for t in tags if (own := places.get(t)) and (i := bisect_right(own, limit)) < len(own)]
        if inside:
            cut(min(inside))

    at, end = 0, len(source)
    tags_end = source.rfind(">") + 1  # no tag begins from here on; comments and declarations do, and take the rest
    while at < end:
        m = TAG.search(source, at, tags_end) if at < tags_end else None
        rest_at = None if m else UNENDED.search(source, max(at, tags_end))
        text = source[at:m.start() if m else rest_at.start() if rest_at else end]
        if text:
            if open_[-1].tag == "head" and text.strip():
                cut(len(open_) - 1)
            open_[-1].children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
            break  # a comment without an end takes the rest
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            stop = {"table"} if name in IMPLIED else SCOPE - {name}
            if places.get(name) and (name == "table" or nearest(stop) < places[name][-1]):
                cut(places[name][-1])
            continue
        if open_[-1].tag == "head" and name not in IN_HEAD:
            cut(len(open_) - 1)
        if name in IMPLIED:
            close(*IMPLIED[name])
        elif name in BLOCK:
            close({"p"}, SCOPE | {"li", "dd", "dt"})
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {}
        if name in ("html", "body") and (name == "html" or places.get("body")):
            continue
        node = Node(name, attrs)
        open_[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(source, at, max(at, tags_end))
            body = source[at:stop.start() if stop else end]
            node.children.append(html.unescape(body) if name in ("title", "textarea") else body)
            at = stop.end() if stop else end
        else:
            places.setdefault(name, []).append(len(open_))
            open_.append(node)
    return root


def unseen(node: Node) -> bool:
    a = node.attrs
    return (node.tag in UNSEEN or "hidden" in a or bool(HIDING.search(a.get("style", "")))
            or (node.tag == "dialog" and "open" not in a))


class Flow:
    """Lines in the making: inline text is collected, breaks and margins between blocks collapse."""

    def __init__(self):
        self.lines, self.line, self.gap, self.blank = [], [], 0, False

    def text(self, s: str, keep: bool) -> None:
        if keep:
            parts = s.replace("\r\n", "\n").split("\n")
            for i, p in enumerate(parts):
                if i:
                    self.cut()
                self.line.append(p)
            return
        body = BLANKS.sub(" ", s)
        if body.startswith(" "):
            body, self.blank = body[1:], self.blank or bool(self.line)
        if not body:
            return
        if self.blank:
            self.line.append(" ")
        self.blank = body.endswith(" ")
        self.line.append(body[:-1] if self.blank else body)

    def cut(self) -> None:
        """End the line, also an empty one."""
        self.put(["".join(self.line)])
        self.line, self.blank = [], False

    def space(self, gap: int) -> None:
        """Start a new block: ``gap`` 1 for a new line, 2 for a blank line between."""
        if self.line:
            self.cut()
        self.blank, self.gap = False, max(self.gap, gap)

    def put(self, lines: list[str]) -> None:
        if lines and self.lines and self.gap == 2:
            self.lines.append("")
        self.gap = 0
        self.lines += [x.replace("\xa0", " ").rstrip() for x in lines]

    def done(self) -> list[str]:
        if self.line:
            self.cut()
        return self.lines


def _number(value: str | None, least: int, most: int, otherwise: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return min(max(int(m[1]), least), most) if m else otherwise


def _run(call):
    """The result of a generator that yields the calls it needs answered, on a stack of our own: any depth will do."""
    stack, value = [call], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(inner)
            value = None
    return value


def _table_lines(table: Node):
    """Cells padded to their column's width, two blanks between columns; a row is as high as its highest cell."""
    captions, rows = [], []

    def walk(node: Node):
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    captions.append(BLANKS.sub(" ", c).strip())  # text outside cells stands before the table
            elif unseen(c):
                continue
            elif c.tag == "tr":
                rows.append([x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th") and not unseen(x)])
                loose = Node("div", {})
                loose.children = [x for x in c.children if not (isinstance(x, Node) and x.tag in ("td", "th"))]
                captions.extend(x for x in (yield _rendered(loose)) if x)
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield walk(c)
            elif c.tag in ("td", "th"):
                rows.append([c])
            else:
                captions.extend((yield _rendered(c)))

    yield walk(table)
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}
    for cells in rows:
        place, col = {}, 0
        for cell in cells:
            while held.get(col, 0) > 0:
                col += 1
            wide, high = _number(cell.attrs.get("colspan"), 1, 1000, 1), _number(cell.attrs.get("rowspan"), 1, 65534, 1)
            place[col] = ((yield _rendered(cell)) or [""], wide)
            for i in range(col, col + wide):
                held[i] = high
            col += wide
        held = {i: n - 1 for i, n in held.items() if n > 1}
        grid.append(place)
    width: dict[int, int] = {}
    for place in grid:
        for col, (lines, wide) in place.items():
            width[col] = max(width.get(col, 0), max(map(len, lines)) if wide == 1 else 0)
    starts, x = {}, 0
    for col in range(max(width, default=-1) + 1):
        starts[col] = x
        x += width.get(col, 0) + 2 if width.get(col, 0) else 0
    out = list(captions)
    for place in grid:
        for i in range(max((len(lines) for lines, _ in place.values()), default=0)):
            line = ""
            for col in sorted(place):
                lines = place[col][0]
                if i < len(lines) and lines[i]:
                    line = line.ljust(starts[col]) if len(line) <= starts[col] else line + "  "
                    line += lines[i]
            out.append(line)
    return out


def _render(node: Node, flow: Flow, keep: bool):
    number = _number(node.attrs.get("start"), -10**9, 10**9, 1)
    for c in node.children:
        if isinstance(c, str):
            flow.text(c, keep)
        elif unseen(c):
            continue
        elif c.tag == "br":
            flow.cut()
        elif c.tag == "table":
            flow.space(2)
            flow.put((yield _table_lines(c)))
            flow.space(2)
        elif c.tag == "li":
            flow.space(1)
            number = _number(c.attrs.get("value"), -10**9, 10**9, number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = (yield _rendered(c)) or [""]
            flow.put([mark + lines[0], *[" " * len(mark) + x for x in lines[1:]]])
            flow.space(1)
        elif c.tag in ("blockquote", "dd") or (c.tag in ("ul", "ol", "menu") and node.tag in ("ul", "ol", "menu")):
            flow.space(2 if c.tag in SPACED and node.tag != "li" else 1)
            flow.put(["  " + x for x in (yield _rendered(c))])
            flow.space(2 if c.tag in SPACED and node.tag != "li" else 1)
        elif c.tag in BLOCK:
            # A list inside a list item follows it without a blank line.
            gap = 2 if c.tag in SPACED and not (node.tag == "li" and c.tag in ("ul", "ol", "menu")) else 1
            flow.space(gap)
            yield _render(c, flow, keep or c.tag == "pre")
            flow.space(gap)
        elif c.tag == "input":
            if c.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text") and c.attrs.get("value"):
                flow.text(" " + c.attrs["value"] + " ", keep)
        else:
            yield _render(c, flow, keep or c.tag == "textarea")


def _rendered(node: Node):
    flow = Flow()
    yield _render(node, flow, node.tag == "pre")
    lines = flow.done()
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return lines


def extract(source: str | None) -> str:
    """Visible text of an HTML document. Null and empty documents give an empty text; plain text comes back with its
    blanks collapsed; broken markup is read as far as it goes, never refused, at any depth."""
    return "\n".join(_run(_rendered(parse(source.replace("\0", ""))))) if source else ""


def visible_text(source: Column) -> Column:
    """The visible text of a column of documents, batch by batch in Arrow."""
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(extract)
    return run(F.coalesce(source, F.lit("")))
