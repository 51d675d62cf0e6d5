"""Layout-aware text of web pages: a tolerant tree builder and a renderer of what is visible."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object svg math canvas audio video datalist".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = PARAGRAPH | frozenset(
    "html body div section article aside header footer nav main form fieldset legend address details dialog summary figcaption caption li dt dd tr center menu dir option".split()
)
# An open element of the second kind ends when one of the first kind begins, unless a barrier lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"body"}),
}
ENDS_P = BLOCK - {"html", "body", "li", "dt", "dd", "tr", "option", "caption", "legend", "summary", "figcaption"}
GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SHOWN = re.compile(r"display\s*:|visibility\s*:", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
SIMPLE = re.compile(r"([a-zA-Z][a-zA-Z0-9-]*)?((?:[.#][\w-]+)*)")
SPANS = {"colspan": 1000, "rowspan": 65534}  # fixed values: what the HTML standard clamps them to
WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """A tree from tag soup: implied end tags, unmatched end tags ignored, everything closed at the end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def _pop_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.count[node.tag] -= 1
        del self.open[depth:]

    def _close(self, kinds: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``kinds`` that no barrier separates from here."""
        if not any(self.count.get(k) for k in kinds):
            return
        found = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in barriers:
                break
            if tag in kinds:
                found = i
        if found is not None:
            self._pop_to(found)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif self.count.get("head") and tag in BLOCK and tag not in ("html", "body"):
            self._close({"head"}, frozenset())
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.open[-1].children.append(Node("br", {}))
            return
        if not self.count.get(tag):
            if tag == "p":  # implies an empty paragraph
                self.open[-1].children.append(Node("p", {}))
            return
        barriers = {"td", "th", "table"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th") else {"table"}
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._pop_to(i)
                return
            if self.open[i].tag in barriers:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


Rules = dict[str, list[tuple[frozenset[str], bool]]]


def css_rules(css: str) -> list[tuple[str, str]]:
    """``(selectors, body)`` of the style rules that hold on a screen, in order; rules of other media are left out."""
    out, css, at = [], COMMENT.sub("", css), 0
    skip: list[bool] = []  # for each open @ block: is it, or one around it, for other media
    while (brace := re.compile(r"[{}]").search(css, at)) is not None:
        head = css[at : brace.start()].rsplit(";", 1)[-1].strip()
        at = brace.end()
        if brace.group() == "}":
            if skip:
                skip.pop()
        elif head.startswith("@"):
            words = re.findall(r"[a-z-]+", head.lower())
            other = "media" in words and not {"all", "screen"} & set(words) and bool({"print", "speech"} & set(words))
            skip.append(other or bool(skip and skip[-1]))
        else:
            end = css.find("}", at)
            end = len(css) if end < 0 else end
            if not (skip and skip[-1]):
                out.append((head, css[at:end]))
            at = end + 1
    return out


def hiding_rules(root: Node) -> Rules:
    """Rules of the page's style elements that decide on visibility: conditions on tag, classes and id, by one of them.

    Only simple selectors are read, lists of them too; those with combinators or pseudo-classes are not.
    """
    rules: Rules = {}
    stack = [root]
    while stack:
        node = stack.pop()
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
        if node.tag != "style":
            continue
        for selectors, body in css_rules("".join(c for c in node.children if isinstance(c, str))):
            if not SHOWN.search(body):
                continue
            for selector in selectors.split(","):
                m = SIMPLE.fullmatch(selector.strip())
                if m and m.group():
                    wanted = [*re.findall(r"[.#][\w-]+", m.group(2)), *([m.group(1).lower()] if m.group(1) else [])]
                    rules.setdefault(wanted[0], []).append((frozenset(wanted), bool(GONE.search(body))))
    return rules


def visible(node: Node, rules: Rules) -> bool:
    """Neither of a kind that shows no text, nor hidden by an attribute, its inline style or the page's rules.

    An inline style wins over rules; of rules, the one with the most conditions, and of equal ones the last.
    """
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    if node.tag == "input" and (node.attrs.get("type") or "").lower() == "hidden":
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    style = node.attrs.get("style")
    if style and SHOWN.search(style):
        return not GONE.search(style)
    if not rules:
        return True
    own = {node.tag, *("." + c for c in (node.attrs.get("class") or "").split())}
    if node.attrs.get("id"):
        own.add("#" + node.attrs["id"])
    found = [(("#" in "".join(wanted), len(wanted)), hides) for x in own for wanted, hides in rules.get(x, ()) if wanted <= own]
    best = max((rank for rank, _ in found), default=None)
    return not [hides for rank, hides in found if rank == best][-1:] == [True]


def span_of(node: Node, name: str) -> int:
    """A cell's span as the HTML standard reads it: leading digits, 1 without any, clamped to its limit. A row span of 0 reaches the end."""
    m = re.match(r"[ \t\n\f\r]*\+?([0-9]+)", node.attrs.get(name) or "")
    n = min(int(m.group(1)[:9]), SPANS[name]) if m else 1
    return SPANS[name] if n == 0 and name == "rowspan" else max(n, 1)


class Flow:
    """Lines of one block context; inline white space collapses, blank lines never pile up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent: list[str] = []
        self.mark = ""
        self.gap = False  # a blank line is due before the next text
        self.space = False  # a space is due before the next inline text

    def text(self, s: str) -> None:
        body = WHITE.sub(" ", s)
        if body[:1] == " ":
            self.space, body = True, body[1:]
        if not body:
            return
        trail = body[-1] == " "
        body = body[:-1] if trail else body
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(body)
        self.space = trail

    def raw(self, s: str) -> None:
        for k, part in enumerate(s.split("\n")):
            if k:
                self.newline(True)
            if part:
                self.line.append(part.rstrip("\r"))

    def newline(self, keep: bool = False) -> None:
        self.space = False
        if self.line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            pad = "".join(self.indent)
            if self.mark:
                pad, self.mark = pad[: len(pad) - len(self.mark)] + self.mark, ""
            self.lines.append((pad + "".join(self.line)).rstrip(" ") if self.line else "")
            self.line = []

    def paragraph(self) -> None:
        self.newline()
        self.gap = True

    def done(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        while self.lines and not self.lines[0].strip():
            self.lines.pop(0)
        return self.lines


def width(s: str) -> int:
    """Columns that a string takes; wide East Asian characters take two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


Cell = tuple[list[str], int, int]


def grid(rows: list[list[Cell]]) -> list[list[tuple[int, list[str], int]]]:
    """``(column, lines, column span)`` of each row's cells: the first columns that no cell from above still fills."""
    filled: list[int] = []  # for each column: how many more rows a cell from above fills
    out = []
    for row in rows:
        placed, at = [], 0
        taken: list[tuple[int, int, int]] = []
        for lines, across, down in row:
            while at < len(filled) and filled[at]:
                at += 1
            placed.append((at, lines, across))
            taken.append((at, across, down))
            at += across
        filled = [max(n - 1, 0) for n in filled]
        for at, across, down in taken:
            filled.extend([0] * (at + across - len(filled)))
            for c in range(at, at + across):
                filled[c] = max(filled[c], down - 1)
        out.append(placed)
    return out


def table_lines(rows: list[list[Cell]]) -> list[str]:
    """Cells in the columns of their grid, padded to the widest of each, two spaces apart.

    A cell over several columns widens the last of them if they are too narrow. A cell over several rows
    stands in the first. So every cell begins where its column does.
    """
    placed = [r for r in grid(rows) if any(any(x.strip() for x in lines) for _, lines, _ in r)]
    widths: list[int] = []
    for row in placed:
        for at, lines, across in row:
            widths.extend([0] * (at + across - len(widths)))
            if across == 1:
                widths[at] = max(widths[at], max(map(width, lines), default=0))
    room = lambda at, across: sum(w + 2 for w in widths[at : at + across] if w) - 2
    for across, at, need in sorted((c, at, max(map(width, lines), default=0)) for row in placed for at, lines, c in row if c > 1):
        if need > room(at, across):
            widths[at + across - 1] += need - max(room(at, across), 0) - (2 if room(at, across) > 0 and not widths[at + across - 1] else 0)
            widths[at + across - 1] = max(widths[at + across - 1], 1)
    # columns without a cell of their own take no room
    begin = [0]
    for w in widths:
        begin.append(begin[-1] + (w + 2 if w else 0))
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, have = [], 0
            for at, lines, _ in row:
                s = lines[k] if k < len(lines) else ""
                if s.strip():
                    line.append(" " * (begin[at] - have) + s)
                    have = begin[at] + width(s)
            out.append("".join(line).rstrip(" "))
    return out


def render(root: Node) -> str:
    """All visible text of a tree, with an own stack: depth is no limit."""
    flow, flows = Flow(), []
    rules = hiding_rules(root)
    tables: list[list[list[Cell]]] = []
    lists: list[list] = []
    pre = 0
    stack: list = [(root, False)]
    while stack:
        item, leaving = stack.pop()
        if isinstance(item, str):
            flow.raw(item) if pre else flow.text(item)
            continue
        tag = item.tag
        if not leaving:
            if not visible(item, rules):
                continue
            if tag == "br":
                flow.newline(True)
                continue
            if tag == "table":
                flow.paragraph()
                tables.append([])
            elif tag in ("td", "th") and tables:
                flows.append(flow)
                flow = Flow()
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in PARAGRAPH and not (tag in ("ul", "ol") and lists):
                flow.paragraph()
            elif tag in BLOCK or tag in ("td", "th"):
                flow.newline()
            if tag in ("ul", "ol", "menu", "dir"):
                start = item.attrs.get("start") or "1"
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                ordered = bool(lists) and lists[-1][0] == "ol"
                mark = f"{lists[-1][1]}. " if ordered else "- "
                if ordered:
                    lists[-1][1] += 1
                flow.indent.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("dd", "blockquote"):
                flow.indent.append("  ")
            elif tag == "pre":
                pre += 1
            stack.append((item, True))
            shown = item.children
            if tag == "details" and "open" not in item.attrs:
                shown = [c for c in shown if isinstance(c, Node) and c.tag == "summary"][:1]
            stack.extend((c, False) for c in reversed(shown))
            continue
        if tag in ("td", "th") and tables:
            lines = flow.done()
            flow = flows.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((lines, span_of(item, "colspan"), span_of(item, "rowspan")))
            continue
        if tag == "table":
            rows = tables.pop()
            flow.newline()
            for line in table_lines(rows):
                flow.line = [line]
                flow.newline()
            flow.paragraph()
        elif tag in PARAGRAPH and not (tag in ("ul", "ol") and len(lists) > 1):
            flow.paragraph()
        elif tag in BLOCK:
            flow.newline()
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            flow.newline()
            flow.indent.pop()
            flow.mark = ""
        elif tag in ("dd", "blockquote"):
            flow.indent.pop()
        elif tag == "pre":
            pre -= 1
    return "\n".join(flow.done())


def page_text(html: str | None) -> str:
    """Visible text of one page; "" of a null."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def html_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text, n_chars)``, one row for each input row, in one scan without a shuffle.

    Block elements start lines, paragraphs and the like are set off by a blank line, list items get a
    mark and an indent by depth, table cells line up in columns, ``pre`` keeps its white space.
    Scripts, styles, the head, closed dialogs, what closed details hold but for their summary, and
    elements hidden by attribute, inline style or a simple rule of the page's styles are left out.
    Broken markup never fails. A null or empty page has the text "". The text follows from the page
    alone, so there are no ties. Repeated rows stay; an empty table gives an empty result; other
    columns are ignored.
    """

    def run(batches):
        for b in batches:
            text = pa.array([page_text(t.as_py()) for t in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["id", "text"])

    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("h"))
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string")
    return out.select(F.col("id").alias(id_col), "text", F.length("text").cast("long").alias("n_chars"))
