"""HTML to visible text by layout-aware rendering.

A tolerant tree builder (implied html, head and body, implied end tags, void and raw-text elements) gives nodes;
the renderer walks them without recursion, applies visibility rules and emits all visible text with block spacing,
list markers and indents, preformatted text, and tables whose cells are aligned in columns.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import small_batches, table

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTR = re.compile(r"""([^\s=/"'>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("rp head script style template noscript iframe noembed noframes object audio video canvas datalist param source track meta link base title area".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure hr xmp listing".split())
BLOCK = MARGIN | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption thead tbody tfoot tr td th".split())
#: A start tag of the first kind ends an open element of the second kinds ...
IMPLIES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th", "caption"}, "th": {"td", "th", "caption"}, "thead": {"caption", "colgroup"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
for _t in ("thead", "tbody", "tfoot"):
    IMPLIES[_t] = {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: ... looking no further out than these.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
TABLE_SCOPE = {"table"}
P_SCOPE = frozenset("button td th caption table html".split())
#: Elements of SVG and MathML that draw no text where they stand; those whose contents are HTML again; HTML's start tags that end SVG and MathML.
FOREIGN_UNSEEN = {"svg": frozenset("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter script style".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
FOREIGN_HTML = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HEAD = frozenset("title style script meta link base template noscript".split())


#: What HTML takes for white space: no-break spaces and the like are text.
WHITE = " \t\n\f\r"
WORDS = re.compile(f"[^{WHITE}]+")
#: Characters that a table's aligned lines may take, for each character and line of its text. Lines of cells that would break it do not widen their columns, longest first, so that output stays in proportion to the page.
PADDED = 16
#: Columns that cells of the rows above may take in a table, for each of its cells; beyond that rowspan is not followed, for the same end.
CARRIED = 50


#: SVG's texts stand apart from one another, and so do the rows of a MathML table.
LINED = {("svg", "text"), ("math", "mtr"), ("math", "mlabeledtr")}


class Node:
    __slots__ = ("tag", "attrs", "kids", "foreign")

    def __init__(self, tag: str, attrs: str = "", foreign: str = ""):
        """foreign: svg or math for an element inside of one."""
        self.tag, self.attrs, self.kids, self.foreign = tag, attrs, [], foreign

    def within(self) -> str:
        """What the element's contents belong to: svg, math or (empty) HTML."""
        if self.foreign:
            return "" if self.tag in FOREIGN_HTML[self.foreign] else self.foreign
        return self.tag if self.tag in FOREIGN_UNSEEN else ""


def build(source: str) -> Node:
    """The tree of a document; text kids are strings with entities resolved."""
    root, body = Node("html"), None
    stack, pos, size = [root], 0, len(source)
    last = source.rfind(">")  # no tag ends behind it
    open_count: dict[str, int] = {}

    def push(node: Node) -> None:
        stack[-1].kids.append(node)
        stack.append(node)
        open_count[node.tag] = open_count.get(node.tag, 0) + 1

    def pop_to(i: int) -> None:
        while len(stack) > i:
            open_count[stack.pop().tag] -= 1

    def need_body() -> None:
        nonlocal body
        if body is None:
            pop_to(1)
            body = Node("body")
            push(body)

    def text(s: str) -> None:
        if not s:
            return
        if body is None and s.strip(WHITE) and stack[-1].tag in ("html", "head"):
            need_body()
        stack[-1].kids.append(entities.unescape(s) if "&" in s else s)

    open_count["html"] = 1
    while pos < size:
        lt = source.find("<", pos)
        if lt < 0:
            text(source[pos:])
            break
        if lt > last:
            text(source[pos:].partition("<!--")[0])
            break
        m = TOKEN.match(source, lt)
        if m is None:
            text(source[pos : lt + 1])
            pos = lt + 1
            continue
        text(source[pos:lt])
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, attrs = name.lower(), (m[3] if m[2] else m[6]) or ""
        if m[1] or m[4]:
            if name == "p" and not open_count.get("p"):
                need_body()
                stack[-1].kids.append(Node("p"))
            elif name == "br":
                need_body()
                stack[-1].kids.append(Node("br"))
            elif open_count.get(name) and name not in ("html", "body"):
                i = len(stack) - 1
                fence = TABLE_SCOPE if name not in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption") else ()
                while i and stack[i].tag != name and stack[i].tag not in fence:
                    i -= 1
                if stack[i].tag == name and i:
                    pop_to(i)
            continue
        if name == "html":
            root.attrs = root.attrs or attrs
            continue
        if name == "head":
            if body is None and not open_count.get("head"):
                push(Node("head", attrs))
            continue
        if name in ("body", "frameset"):
            need_body()
            body.attrs = body.attrs or attrs
            continue
        if body is None and name not in HEAD:
            need_body()
        while name in ENDS_FOREIGN and stack[-1].within():
            pop_to(len(stack) - 1)
        foreign = stack[-1].within()
        if name in CLOSES_P and open_count.get("p"):
            i = len(stack) - 1
            while i and stack[i].tag != "p" and stack[i].tag not in P_SCOPE:
                i -= 1
            if stack[i].tag == "p":
                pop_to(i)
        if (ends := IMPLIES.get(name)) and any(open_count.get(t) for t in ends):
            fence, found, i = SCOPE.get(name, TABLE_SCOPE), 0, len(stack) - 1
            while i and stack[i].tag not in fence:
                if stack[i].tag in ends:
                    found = i
                i -= 1
            if found:
                pop_to(found)
        node = Node(name, attrs, foreign)
        if name in VOID or attrs.endswith("/") and (foreign or name in FOREIGN_UNSEEN):
            stack[-1].kids.append(node)
        elif name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(source, pos, last + 1)
            inner = source[pos : end.start() if end else size]
            stack[-1].kids.append(node)
            node.kids.append(entities.unescape(inner) if name in ("title", "textarea") else inner)
            pos = end.end() if end else size
        else:
            push(node)
    return root


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in ATTR.finditer(raw)}


def shown(attrs: dict[str, str], tag: str, inherited: bool) -> tuple[bool, bool]:
    """(the element makes boxes, its text is visible) by hidden, type and inline style."""
    if "hidden" in attrs or tag == "input" and attrs.get("type", "").lower() == "hidden" or tag == "dialog" and "open" not in attrs:
        return False, inherited
    style = re.sub(r"\s", "", attrs.get("style", "")).lower()
    if re.search(r"(?:^|;)display:none", style):
        return False, inherited
    m = re.search(r"(?:^|;)visibility:(visible|hidden|collapse)", style)
    return True, m[1] == "visible" if m else inherited


def drawn(attrs: dict[str, str], inherited: bool) -> tuple[bool, bool]:
    """As shown(), by the attributes that SVG has for the same; a style goes first."""
    style = re.sub(r"\s", "", attrs.get("style", "")).lower()
    if attrs.get("display", "").strip().lower() == "none" and not re.search(r"(?:^|;)display:", style):
        return False, inherited
    said = attrs.get("visibility", "").strip().lower()
    if said in ("visible", "hidden", "collapse") and not re.search(r"(?:^|;)visibility:", style):
        return True, said == "visible"
    return True, inherited


class Flow:
    """Lines of one formatting context: collapses white space, keeps margins, markers and indents."""

    def __init__(self):
        self.lines, self.cur, self.gap, self.blank = [], [], 0, False
        self.indents, self.marker = [], ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.cur.append(first)
            for line in rest:
                self.line(True)
                self.cur.append(line)
            return
        words = s.split() if s.isascii() else WORDS.findall(s)
        if not words:
            self.blank = self.blank or bool(s)
            return
        if (self.blank or s[0] in WHITE) and self.cur:
            self.cur.append(" ")
        self.cur.append(" ".join(words))
        self.blank = s[-1] in WHITE

    def line(self, keep: bool = False) -> None:
        s = "".join(self.cur)
        self.cur, self.blank = [], False
        if s.strip(WHITE) or keep:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            indent = "".join(self.indents)
            if self.marker:
                indent = indent[: max(0, len(indent) - len(self.marker))] + self.marker
                self.marker = ""
            self.lines.append((indent + s).rstrip(WHITE))

    def block(self, margin: int) -> None:
        if self.cur:
            self.line()
        self.gap = max(self.gap, margin)

    def finish(self) -> list[str]:
        self.block(0)
        return self.lines


class Grid:
    """Cells of one table, rendered in aligned columns."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.breaks: set[int] = set()  # rows that begin a row group: no cell reaches into them from above

    def placed(self, carry: bool = True) -> list[list[tuple[list[str], int]]]:
        """(cell, columns) of each row; with carry, empty cells stand where cells of the rows above reach down to."""
        out, until, left = [], {}, CARRIED * (10 + sum(map(len, self.rows)))
        for k, row in enumerate(self.rows):
            if k in self.breaks:
                until = {}
            col, cells = 0, []
            for cell, span, down in row:
                first = col
                while carry and until.get(col, 0) > k:
                    col += 1
                if col > first:
                    cells.append(([], col - first))
                    left -= col - first
                if down != 1:
                    until |= dict.fromkeys(range(col, col + span), k + down if down else len(self.rows))
                    left -= span - 1
                if left < 0 and carry:
                    return self.placed(False)
                cells.append((cell, span))
                col += span
            out.append(cells)
        return out

    def tracks(self) -> tuple[list[list[tuple[list[str], int, int]]], int]:
        """(cell, first track, track behind it) of each row and the number of tracks: columns in which no cell begins are one with the column before."""
        rows = self.placed()
        begins = set()
        for row in rows:
            col = 0
            for _, span in row:
                begins.add(col)
                col += span
        order, out = sorted(begins), []
        for row in rows:
            col, cells = 0, []
            for cell, span in row:
                cells.append((cell, bisect_left(order, col), bisect_left(order, col + span)))
                col += span
            out.append(cells)
        return out, len(order)

    def lines(self) -> list[str]:
        rows, many = self.tracks()
        heights = [max((len(cell) for cell, _, _ in row), default=0) for row in rows]
        text = sum(heights) + sum(len(s) for row in rows for cell, _, _ in row for s in cell)

        def edges(most: int) -> list[int]:
            """Where each track begins if only lines of up to `most` characters widen it."""
            widths = [0] * many
            wide = lambda cell: max((n for s in cell if (n := len(s)) <= most), default=0)
            for row in rows:
                for cell, t, z in row:
                    if z - t == 1:
                        widths[t] = max(widths[t], wide(cell))
            for row in rows:
                for cell, t, z in row:
                    if z - t > 1 and (n := wide(cell)):
                        widths[z - 1] += max(0, n - sum(widths[t:z]) - 2 * (z - t - 1))
            return list(accumulate((w + 2 for w in widths), initial=0))

        def taken(most: int) -> int:
            """Characters before the last cell of each line."""
            at = edges(most)
            return sum(h * max((at[t] for cell, t, _ in row if cell), default=0) for h, row in zip(heights, rows))

        sizes = sorted({len(s) for row in rows for cell, _, _ in row for s in cell} | {0})
        low, high = -1, len(sizes) - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if taken(sizes[middle]) <= PADDED * text else (low, middle - 1)
        at = edges(sizes[low]) if low >= 0 else None
        out = []
        for row, height in zip(rows, heights):
            for k in range(height):
                parts = []
                for cell, t, z in row:
                    s = cell[k] if k < len(cell) else ""
                    parts.append(s.ljust(at[z] - at[t] - 2) if at else s)
                out.append("  ".join(parts).rstrip(WHITE))
        return out


def render(source: str | None) -> str:
    """All visible text of an HTML document; empty for null or empty sources."""
    if not source:
        return ""
    flow, flows, grids, lists = Flow(), [], [], []
    work = [(build(source), True, False, False)]
    while work:
        node, visible, pre, leave = work.pop()
        if isinstance(node, str):
            if visible:
                flow.text(node, pre)
            continue
        tag = node.tag
        if leave:
            if tag in ("td", "th") and grids and flows:
                cell = flow.finish()
                flow = flows.pop()
                a = attributes(node.attrs) if node.attrs else {}
                try:
                    span = min(1000, max(1, int(a.get("colspan", "1"))))
                except ValueError:
                    span = 1
                try:
                    down = max(0, int(a.get("rowspan", "1")))
                except ValueError:
                    down = 1
                if not grids[-1].rows:
                    grids[-1].rows.append([])
                grids[-1].rows[-1].append((cell, span, down))
                continue
            if tag == "table":
                lines = grids.pop().lines()
                flow.block(1)
                for s in lines:
                    flow.cur = [s]
                    flow.line(True)
                flow.block(1)
                continue
            if (node.foreign, tag) in LINED:
                flow.block(0)
                continue
            if tag in ("thead", "tbody", "tfoot") and grids:
                grids[-1].breaks.add(len(grids[-1].rows))
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag in ("ul", "ol", "menu", "blockquote", "dd") and flow.indents:
                flow.block(0)
                flow.indents.pop()
            if tag == "li":
                flow.block(0)
                if flow.marker:
                    flow.cur = [""]
                    flow.line(True)
            if tag in BLOCK:
                flow.block(1 if tag in MARGIN and not (tag in ("ul", "ol", "menu") and lists) else 0)
            elif tag == "q":
                flow.text("”", False)
            continue
        if tag in UNSEEN or node.foreign and tag in FOREIGN_UNSEEN[node.foreign]:
            continue
        boxed, seen = True, visible
        if node.attrs and ("hidden" in node.attrs.lower() or "style" in node.attrs.lower() or tag in ("input", "dialog")):
            boxed, seen = shown(attributes(node.attrs), tag, visible)
        elif tag == "dialog":
            boxed = False
        if boxed and node.attrs and (node.foreign or tag == "svg"):
            boxed, seen = drawn(attributes(node.attrs), seen)
        if not boxed:
            continue
        kids = node.kids
        if tag == "details" and not node.foreign and "open" not in attributes(node.attrs):
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if (node.foreign, tag) in LINED:
            flow.block(0)
        elif (node.foreign, tag) == ("math", "mtd"):
            flow.text(" ", False)
        if tag == "br":
            flow.line(True) if seen else None
            continue
        if tag == "hr":
            flow.block(1)
            continue
        if tag in ("input", "img"):
            a = attributes(node.attrs)
            if seen and tag == "input" and a.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel") and a.get("value"):
                flow.text(a["value"], False)
            continue
        if tag in ("td", "th") and grids:
            flows.append(flow)
            flow = Flow()
        elif tag == "table":
            flow.block(1)
            grids.append(Grid())
        elif tag == "tr" and grids:
            grids[-1].rows.append([])
        elif tag in ("thead", "tbody", "tfoot") and grids:
            grids[-1].breaks.add(len(grids[-1].rows))
            flow.block(0)
        elif tag in BLOCK:
            flow.block(1 if tag in MARGIN and not (tag in ("ul", "ol", "menu") and lists) else 0)
            if tag in ("ul", "ol", "menu"):
                a = attributes(node.attrs) if node.attrs else {}
                try:
                    lists.append(int(a.get("start", "1")) if tag == "ol" else None)
                except ValueError:
                    lists.append(1)
                flow.indents.append("   " if tag == "ol" else "  ")
            elif tag == "li":
                if lists and lists[-1] is not None:
                    flow.marker = f"{lists[-1]}. "
                    lists[-1] += 1
                else:
                    flow.marker = "- "
                if not seen:
                    flow.marker = ""
            elif tag in ("blockquote", "dd"):
                flow.indents.append("  ")
        elif tag == "q":
            flow.text("“", False)
        inner = pre or tag in ("pre", "xmp", "listing", "textarea", "plaintext")
        if inner and not pre and kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
            kids = [kids[0][1:], *kids[1:]]
        if tag == "table":
            work.append((node, seen, pre, True))
            for kid in reversed(kids):
                if isinstance(kid, str):
                    if not kid.strip(WHITE):
                        continue
                work.append((kid, seen, inner, False))
            continue
        work.append((node, seen, pre, True))
        if tag in ("tr", "thead", "tbody", "tfoot") and grids:
            kids = [k for k in kids if not isinstance(k, str) or k.strip(WHITE)]
        work += [(kid, seen, inner, False) for kid in reversed(kids)]
    while flows:
        flow = flows.pop()
    return "\n".join(flow.finish()).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row: all visible text of the whole page; null and empty pages give empty text.

    Repeated rows stay; other columns are not read; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(h) for h in b.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, text string")


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
