"""HTML extraction as a layout-aware rendering of whole pages.

A tree builder makes elements of the parser's events, adding the end tags that HTML lets
authors leave out. A renderer walks the tree without recursion, leaves out what a browser
wouldn't show (by element, attribute, inline style and the rules for tags, classes and ids of
the page's own style sheets, in the order of the cascade; visibility is inherited) and writes
all other text: blocks on lines of their own, paragraphs and headings apart, list items with
their markers, table cells in aligned columns, preformatted text as is. Rules with other
selectors and media queries that ask for more than a screen are left alone; closed details and
the options of a select are written, as a click shows them.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed sets of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link base datalist audio video canvas iframe object param source track area map col colgroup noframes progress meter".split())
UNSEEN_IN_SVG = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
UNSEEN_IN_MATH = frozenset("annotation annotation-xml".split())
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Inputs that show no text.
BLIND = frozenset("hidden password checkbox radio file image color range".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset form hr".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body caption center dd details dialog dir div dt fieldset figcaption footer header hgroup html legend li main menu nav option section summary tbody td tfoot th thead tr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dd dt".split())
#: Start tag -> the open elements that it ends, and where the search for them stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
#: A p's end is looked for up to these.
SCOPE = frozenset("table td th caption html body button object template".split())
TABLE = ("table", "tr", "tbody", "thead", "tfoot", "td", "th")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
QUOTED = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S)
COMPOUND = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)", re.I)
PART = re.compile(r"([.#])([\w-]+)")
BRACE = re.compile(r"[{};]")
BLANK = re.compile(r"[ \t\n\r\f\v]+")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Keeps, beside the stack of open elements, the places of each tag in it, so that depth costs nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.styles: list[str] = []

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def cut(self, place: int) -> None:
        while len(self.open) > place:
            self.at[self.open.pop().tag].pop()

    def close_to(self, tags: tuple, stops) -> None:
        """Ends open elements up to the outermost one of these tags inside the nearest stop."""
        stop = self.last(stops)
        inside = [places[i] for t in tags if (i := bisect(places := self.at[t], stop)) < len(places)]
        if inside:
            self.cut(min(inside))

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            self.root.attrs |= dict(attrs)
            return
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.cut(len(self.open) - 1)
        if tag in ENDS:
            self.close_to(*ENDS[tag])
        if tag in CLOSES_P:
            self.close_to(("p",), SCOPE)
        element = Element(tag, dict(attrs))
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (self.at["svg"] or self.at["math"]):  # elsewhere the slash of a non-void element has no meaning
            self.cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br" or tag == "p" and self.last(("p",)) <= self.last(SCOPE):
            self.handle_starttag(tag, [])  # a p without a start is an empty one
        if tag == "br":
            return
        if self.at[tag] and (tag in TABLE or self.at[tag][-1] > self.last(("td", "th", "table"))):  # else an end tag inside a cell ends nothing outside it
            self.cut(self.at[tag][-1])

    def handle_data(self, data):
        top = self.open[-1]
        if top.tag == "head" and data.strip():
            self.cut(len(self.open) - 1)
        if top.tag == "style" and on_screen(top.attrs.get("media") or ""):
            self.styles.append(data)
        self.open[-1].children.append(data)


def on_screen(media: str) -> bool:
    return not media.strip() or any(m.strip().lower() in ("all", "screen", "only screen") for m in media.split(","))


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """Name -> (important, value) of declarations; of two the later one counts, unless only the earlier is important."""
    out: dict = {}
    for part in QUOTED.sub('""', COMMENT.sub("", style)).split(";"):
        name, colon, value = part.partition(":")
        if colon:
            value = value.strip().lower()
            important = value.endswith("!important")
            name, value = name.strip().lower(), value.removesuffix("!important").strip()
            if important or not out.get(name, (False,))[0]:
                out[name] = (important, value)
    return out


SEEN_BY = ("display", "visibility", "content-visibility")


class Sheet:
    """The rules of a page's style sheets that decide what is shown, by the last name of their selectors."""

    def __init__(self, css: str):
        self.rules: dict[str, list] = defaultdict(list)
        self.count = 0
        self.read(QUOTED.sub('""', COMMENT.sub("", css)))

    def read(self, css: str) -> None:
        """In one pass: blocks of at-rules that hold on a screen count as if their rules stood alone, other blocks of at-rules are skipped."""
        start, begun, depth, held = 0, None, 0, 0  # of a prelude, of a block being read or skipped, braces open in it, at-rules around
        for m in BRACE.finditer(css):
            if m[0] == "{":
                prelude = "" if depth else css[start : m.start()].strip()
                name, _, asked = prelude[1:].partition(" ")
                if prelude.startswith("@") and (name.lower() == "layer" or name.lower() == "media" and on_screen(asked)):
                    held, start = held + 1, m.end()
                    continue
                begun, depth = begun if depth else m.end(), depth + 1
            elif depth:
                depth -= m[0] == "}"
                if not depth:
                    self.rule(css[start : begun - 1].strip(), css[begun : m.start()])
                    start = m.end()
            else:  # the end of an at-rule, with a block or without
                start, held = m.end(), held - (held > 0 and m[0] == "}")

    def rule(self, prelude: str, body: str) -> None:
        said = {k: v for k, v in declared(body).items() if k in SEEN_BY}
        for selector in prelude.split(",") if said and not prelude.startswith("@") else ():
            if (selector := selector.strip()) and (m := COMPOUND.fullmatch(selector)):
                tag, parts = (m[1] or "*").lower(), PART.findall(m[2])
                weight = (sum(k == "#" for k, _ in parts), sum(k == "." for k, _ in parts), int(tag != "*"))
                self.count += 1
                self.rules["".join(parts[-1]) if parts else tag].append((tag, {"".join(x) for x in parts}, weight, self.count, said))

    def of(self, e: Element) -> dict[str, str]:
        """What the cascade gives an element."""
        best: dict = {}

        def offer(said: dict, weight: tuple, order: int) -> None:
            for name, (important, value) in said.items():
                rank = (important, weight, order)
                if name not in best or rank >= best[name][0]:
                    best[name] = (rank, value)

        if self.rules:
            names = {f".{c}" for c in (e.attrs.get("class") or "").split()} | ({f"#{e.attrs['id']}"} if e.attrs.get("id") else set())
            for key in ("*", e.tag, *names):
                for tag, parts, weight, order, said in self.rules.get(key, ()):
                    if tag in ("*", e.tag) and parts <= names:
                        offer(said, weight, order)
        if e.attrs.get("style"):
            offer({k: v for k, v in declared(e.attrs["style"]).items() if k in SEEN_BY}, (1 << 30,), 0)
        return {name: value for name, (_, value) in best.items()}


def shows(e: Element, sheet: Sheet, visible: bool, inside: str) -> bool | None:
    """Whether an element's own text is visible; None: nothing in it can be."""
    tag, a = e.tag, e.attrs
    if tag in UNSEEN or inside == "svg" and tag in UNSEEN_IN_SVG or inside == "math" and tag in UNSEEN_IN_MATH:
        return None
    said = sheet.of(e) if sheet.rules or "style" in a else {}
    display = said.get("display") or ("none" if "hidden" in a or tag == "dialog" and "open" not in a else "")
    if display == "none" or said.get("content-visibility") == "hidden":
        return None
    own = said.get("visibility", "inherit")
    return visible if own in ("inherit", "unset") else own not in ("hidden", "collapse")


class Page:
    """Lines of text under construction: collapses white space, keeps blocks apart."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.prefix, self.pending = [], 0, "", ""

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.split("\n")
            self.put(first)
            for part in rest:
                self.flush(force=True)
                self.put(part)
            return
        data = BLANK.sub(" ", data)
        if not self.line or self.line[-1].endswith(" "):
            data = data.lstrip(" ")
        if data:
            self.put(data)

    def put(self, data: str) -> None:
        if data:
            self.line.append(data)

    def flush(self, force: bool = False) -> None:
        line = "".join(self.line).rstrip()
        if line or force:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append((self.prefix + self.pending + line).rstrip() if line else "")
            if line:
                self.pending = ""
        self.line = []

    def block(self, apart: int = 0) -> None:
        self.flush()
        self.gap = max(self.gap, apart)

    def result(self) -> list[str]:
        self.flush()
        return self.lines


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (cell lines, columns and rows that it spans; 0 rows: all that follow) as text with aligned columns, two spaces apart."""
    taken: dict[int, int] = {}  # column -> the last row that a cell from above reaches
    widths: dict[int, int] = {}
    placed = []
    for y, row in enumerate(rows):
        at, cells = 0, []
        for lines, columns, deep in row:
            while taken.get(at, -1) >= y:
                at += 1
            if columns == 1:
                widths[at] = max([widths.get(at, 0), *map(len, lines)])
            if deep != 1:
                taken |= dict.fromkeys(range(at, at + columns), y + deep - 1 if deep else len(rows))
            cells.append((lines, at))
            at += columns
        placed.append(cells)
    starts, total = {}, 0
    for x in range(max([at for cells in placed for _, at in cells], default=-1) + 1):
        starts[x] = total
        total += widths.get(x, 0) + 2
    out = []
    for cells in placed:
        for i in range(max([len(lines) for lines, _ in cells], default=0)):
            parts, filled = [], 0
            for lines, at in cells:
                if i < len(lines):
                    parts += [" " * max(0, starts[at] - filled), lines[i]]
                    filled = max(filled, starts[at]) + len(lines[i])
            out.append("".join(parts).rstrip())
    return out


def span_of(value: str | None, least: int = 1, most: int = 1000) -> int:
    return min(most, max(least, int(value))) if value and value.isascii() and value.isdigit() and len(value) < 6 else 1


def said_by(e: Element) -> str:
    """What an input or an image shows as text."""
    a = e.attrs
    if e.tag == "img":
        return a.get("alt") or ""
    kind = (a.get("type") or "").lower()
    return "" if kind in BLIND else a.get("value") or a.get("placeholder") or {"submit": "Submit", "reset": "Reset"}.get(kind, "")


def render(html: str | None) -> str:
    """All visible text of a page, without a line feed at its end."""
    if not html:
        return ""
    tree = TreeBuilder()
    tree.feed(html)
    tree.close()
    sheet = Sheet("\n".join(tree.styles))
    pages, tables, lists, kept = [Page()], [], [], 0
    stack: list = [("enter", tree.root, True, "")]
    while stack:
        what, e, visible, inside = stack.pop()
        page = pages[-1]
        if what == "enter" and isinstance(e, str):
            if visible:
                page.text(e, kept > 0)
            continue
        tag = e.tag
        if what == "enter":
            visible = shows(e, sheet, visible, inside)
            if visible is None:
                continue
            if tag == "br":
                page.flush(force=True)
                continue
            if tag == "wbr":
                continue
            if tag in ("img", "input"):
                if visible:
                    page.text(said_by(e), False)
                continue
            if tag == "table":
                page.block(1)
                tables.append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                pages.append(Page())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCKS:
                page.block(int(tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists)))
            if tag in ("ul", "ol", "menu", "dir"):
                start = e.attrs.get("start") or "1"
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1, page.prefix + "  " * bool(lists)])
            elif tag == "li":
                ordered, number, before = lists[-1] if lists else [False, 1, page.prefix]
                marker = f"{number}. " if ordered else "- "
                if lists:
                    lists[-1][1] += 1
                page.prefix, page.pending = before, marker
            elif tag in ("pre", "textarea"):
                kept += 1
            elif tag == "hr":
                if visible:
                    page.put("---")
                page.block(1)
                continue
            stack.append(("leave", e, visible, inside))
            inside = tag if tag in ("svg", "math") else inside
            stack += [("enter", c, visible, inside) for c in reversed(e.children)]
            continue
        if tag in ("td", "th") and tables:
            pages.pop()
            tables[-1][-1].append((page.result(), span_of(e.attrs.get("colspan")), span_of(e.attrs.get("rowspan"), 0, 65534)))
        elif tag == "table":
            for line in table_lines(tables.pop()):
                page.put(line)
                page.flush(force=True)
            page.block(1)
        elif tag == "tr":
            pass
        elif tag in BLOCKS:
            page.block(int(tag in PARAGRAPHS and not (tag in ("ul", "ol") and len(lists) > 1)))
        if tag in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
            page.prefix = lists[-1][2] if lists else ""
        elif tag == "li":
            page.pending = ""
        elif tag in ("pre", "textarea"):
            kept -= 1
    lines = pages[0].result()
    return "\n".join(lines).strip("\n")


def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), 256):
            s = b.slice(i, 256)
            yield pa.record_batch([s.column(0), pa.array([render(h) for h in s.column(1).to_pylist()], pa.string())], names=["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row for each row of pages (page_id, html): page_id, text.

    Null and empty pages, and pages without visible text, give an empty text. Pages are
    rendered whole, at any length and depth. Rows that repeat give their result each. Other
    columns are not read. An empty table gives an empty result.
    """
    return pages.select("page_id", "html").mapInArrow(rendered, "page_id long, text string")
