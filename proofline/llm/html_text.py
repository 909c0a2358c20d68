"""Visible text of HTML, laid out as a page shows it.

A tolerant tree builder closes what HTML lets authors leave open (paragraphs,
list items, table cells and the like) and ignores stray end tags. Rendering
walks the tree: what is not shown (the elements ``UNSEEN``, hidden elements and
styles) is left out, everything else is kept, at any depth; what ``visibility``
hides can be shown again by an element within. Blocks start on lines
of their own, paragraphs and headings stand between blank lines, list items carry
bullets or numbers and are indented, table columns are aligned (also below cells
that reach down), ``pre`` keeps its spaces.

Layout has three bounds, which no text is lost by: lists, tables and quotes within
``LAYOUT_LEVELS`` others are laid out as plain blocks, and cells wider than
``WIDEST_CELL`` don't widen their column, and cells that reach down keep their place in
the first ``MOST_COLUMNS`` columns. Time and text stay linear in the page.

Defined results: null html gives null text, empty html empty text; a tag whose
quotes don't end ends at the next ``>``; repeated rows give a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from proofline.llm.common import small_batches
from proofline.llm.tokens import slices

LAYOUT_LEVELS = 32
WIDEST_CELL = 60
_TAG_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_MARK = re.compile("[\"'>]")
_MAY_HIDE = re.compile("hidden|style", re.I)
#: Pages without this, or a reference that could spell it, hide nothing by visibility.
_VISIBILITY = re.compile(r"visibility|style[^>]*&", re.I)
#: Rows that a cell reaches down at most, and columns in which cells that reach down are minded.
MOST_ROWS, MOST_COLUMNS = 65_534, 1_000
_Cell = tuple[list[str], int, int]
#: A name, and its value if there is one; a quote that stays open ends with the tag.
_ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|$)|'([^']*+)(?:'|$)|([^\s"'>][^\s>]*+)))?+""")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_SPACE = re.compile(r"[ \t\r\n\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object datalist audio video canvas desc metadata defs symbol clippath mask lineargradient radialgradient filter pattern marker annotation annotation-xml".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body details dialog dd div dt fieldset figcaption footer form header html legend li main menu nav option optgroup section select summary caption center".split())
#: An opening tag closes open elements of these names, up to an element that bounds the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_P_ENDS = BLOCKS - {"option", "optgroup", "select", "html", "body"}
_BOUNDS = frozenset({"table", "td", "th", "caption", "button", "object"})
HEAD_TAGS = frozenset("title meta link base script style template noscript".split())


class Node:
    __slots__ = ("tag", "children", "attributes")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.attributes = tag, [], attributes


class _Tags:
    """Where tags end: at the first ``>`` outside quotes.

    Whether one comes at all is known for every mark that was met in vain, and
    the next mark is kept, so that finding all tags of a page takes one pass.
    """

    def __init__(self, html: str):
        self.html, self.vain = html, set()
        self.since = self.until = -1

    def _mark(self, at: int) -> int:
        if not self.since <= at <= self.until:
            found = _MARK.search(self.html, at)
            self.since, self.until = at, found.start() if found else len(self.html)
        return self.until

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``; -1 for none."""
        met = []
        while True:
            mark = self._mark(at)
            if mark < len(self.html) and self.html[mark] == ">":
                return mark
            close = self.html.find(self.html[mark], mark + 1) if mark < len(self.html) and mark not in self.vain else -1
            met.append(mark)
            if close < 0:
                self.vain.update(met)
                return self.html.find(">", met[0])
            at = close + 1


class _Open:
    """The open elements, and where those of each name are."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.at[self.nodes.pop().tag].pop()

    def _last(self, names) -> int:
        return max((places[-1] for n in names if (places := self.at.get(n))), default=0)

    def close(self, names: set[str], bounds: set[str]) -> bool:
        """Closes the last open element of these names, unless one of ``bounds`` was opened after it."""
        last = self._last(names)
        if not last or last < self._last(bounds):
            return False
        while len(self.nodes) > last:
            self.pop()
        return True


def parse(html: str) -> Node:
    """The tree of a page; text nodes are strings."""
    root = Node("#root")
    opened, tags = _Open(root), _Tags(html)
    at, end, last = 0, len(html), html.rfind(">")
    while at < end:
        start = html.find("<", at)
        if start > last:  # no tag ends any more, but a comment may begin
            start = html.find("<!--", start)
        start = start if start >= 0 else end
        if start > at:
            text = html[at:start]
            if opened.nodes[-1].tag == "head" and text.strip():
                opened.pop()
            opened.nodes[-1].children.append(unescape(text) if "&" in text else text)
            at = start
            continue
        if html.startswith("<!--", at):
            at = html.find("-->", at + 4) + 3
            at = at if at > 2 else end
            continue
        if html[at + 1] in "!?":
            at = html.find(">", at) + 1
            continue
        m = _TAG_NAME.match(html, at)
        if m is None:
            opened.nodes[-1].children.append("<")
            at += 1
            continue
        stop = tags.end(m.end())
        attributes, at, tag = html[m.end() : stop], stop + 1, m[2].lower()
        if m[1]:
            opened.close({tag}, _BOUNDS - {tag} if tag not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
            continue
        if tag in _P_ENDS:
            opened.close({"p"}, _BOUNDS)
        if tag in CLOSES:
            names, bounds = CLOSES[tag]
            while opened.close(names, bounds):
                pass
        elif opened.nodes[-1].tag == "head" and tag not in HEAD_TAGS:
            opened.pop()
        node = Node(tag, attributes)
        opened.nodes[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            stop = close.start() if close else end
            body = html[at:stop]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            at = (html.find(">", stop) + 1 or end) if close else end
        else:
            opened.push(node)
    return root


def _attributes(node: Node) -> dict[str, str]:
    """Values by lower-case name, empty for none; the first of a name counts."""
    out: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(node.attributes):
        out.setdefault(key.lower(), "".join(values))
    return out


def _style(node: Node) -> dict[str, str]:
    """Values of a node's own declarations, by the last one of each name or the last important one."""
    last: dict[str, tuple[bool, str]] = {}
    for declaration in _COMMENT.sub("", unescape(_attributes(node).get("style", ""))).split(";"):
        name, _, value = declaration.partition(":")
        name, (value, mark, _) = name.strip().lower(), value.strip().lower().partition("!")
        if mark or not last.get(name, (False,))[0]:
            last[name] = (bool(mark), value.strip())
    return {name: value for name, (_, value) in last.items()}


def _shown(node: Node) -> bool:
    """Whether a node is laid out at all; ``visibility`` is ``_leave_visible``'s concern."""
    if node.tag in UNSEEN:
        return False
    if not node.attributes or node.tag != "input" and not _MAY_HIDE.search(node.attributes):
        return True
    found = _attributes(node)
    if "hidden" in found or node.tag == "input" and unescape(found.get("type", "")).lower() == "hidden":
        return False
    return "style" not in found or _style(node).get("display") != "none"


def _leave_visible(root: Node) -> Node:
    """Takes out what ``visibility`` hides: it is inherited, and elements within can set it back.

    Cells stay, without content; other elements of which nothing is visible go.
    """
    stack = [(root, True, iter(root.children), [])]
    while stack:
        node, visible, children, kept = stack[-1]
        child = next(children, None)
        if child is None:
            node.children = kept
            stack.pop()
            if stack and (visible or kept or node.tag in ("td", "th")):
                stack[-1][3].append(node)
        elif isinstance(child, str):
            if visible:
                kept.append(child)
        else:
            own = _style(child).get("visibility") if child.attributes and _MAY_HIDE.search(child.attributes) else None
            sees = True if own in ("visible", "initial") else False if own in ("hidden", "collapse") else visible
            stack.append((child, sees, iter(child.children), []))
    return root


def _attribute(node: Node, name: str) -> str | None:
    return _attributes(node).get(name)


class _Page:
    """Lines of text; ``blank`` asks for a blank line before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words[:1] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        if self.line and self.space:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words[:-1] if self.space else words)

    def end_line(self) -> None:
        if self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append("".join(self.line))
        self.line, self.space = [], False

    def paragraph(self) -> None:
        self.end_line()
        self.blank = True

    def gap(self) -> None:
        self.space = True

    def block(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines += lines


def _number(text: str | None, other: int) -> int:
    return int(text) if text and text.isascii() and text.lstrip("-").isdigit() and len(text) < 10 else other


def _list(node: Node, level: int) -> list[str]:
    at, out = _number(_attribute(node, "start"), 1), []
    loose = Node("#loose")
    for child in [*node.children, None]:
        if isinstance(child, Node) and child.tag == "li" or child is None:
            if any(not isinstance(c, str) or c.strip() for c in loose.children):
                out += ["  " + x if x else x for x in _lines(loose, level)]
            loose = Node("#loose")
            if child is not None and _shown(child):
                at = _number(_attribute(child, "value"), at) if node.tag == "ol" and child.attributes else at
                mark = f"{at}. " if node.tag == "ol" else "* "
                at += 1
                lines = _lines(child, level)
                out += [(mark if k == 0 else " " * len(mark)) + x if x else x for k, x in enumerate(lines or [""])] if lines else []
        else:
            loose.children.append(child)
    return out


def _cell(node: Node, level: int) -> _Cell:
    span = lambda name, most: max(1, min(_number(_attribute(node, name), 1), most)) if node.attributes else 1
    down = MOST_ROWS if node.attributes and _attribute(node, "rowspan") == "0" else span("rowspan", MOST_ROWS)
    return (_lines(node, level) if _shown(node) else [], span("colspan", 100), down)


def _rows(node: Node, rows: list[tuple[Node, list[_Cell]]], before: list[str], level: int) -> None:
    """Rows of cells, with the part of the table that they are in; what stands in a table outside of them goes before it."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                before.append(_SPACE.sub(" ", child).strip())
        elif _shown(child):
            if child.tag == "tr":
                cells, rest = [], Node("#rest")
                for c in child.children:
                    (cells if isinstance(c, Node) and c.tag in ("td", "th") else rest.children).append(c)
                before += [x for x in _lines(rest, level) if x]
                rows.append((node, [_cell(c, level) for c in cells]))
            elif child.tag in ("thead", "tbody", "tfoot"):
                _rows(child, rows, before, level)
            elif child.tag in ("td", "th"):
                rows.append((node, [(_lines(child, level), 1, 1)]))
            else:
                before += _lines(child, level)


def _placed(rows: list[tuple[Node, list[_Cell]]]) -> list[list[tuple[int, list[str], int]]]:
    """The cells of each row with their columns: cells of rows above may reach down, within their part of the table."""
    out, until, part = [], {}, None
    for number, (own, cells) in enumerate(rows):
        if own is not part:
            until, part = {}, own
        placed, column = [], 0
        for lines, across, down in cells:
            while until and column < MOST_COLUMNS and until.get(column, 0) > number:
                column += 1
            placed.append((column, lines, across))
            if down > 1:
                until |= {c: number + down for c in range(column, min(column + across, MOST_COLUMNS))}
            column += across
        out.append(placed)
    return out


def _table(node: Node, level: int) -> list[str]:
    rows: list[tuple[Node, list[_Cell]]] = []
    out: list[str] = []
    _rows(node, rows, out, level)
    placed, widths = _placed(rows), {}
    for row in placed:
        for column, lines, across in row:
            if across == 1:
                widths[column] = max(widths.get(column, 0), max((len(x) for x in lines if len(x) <= WIDEST_CELL), default=0))
    for row in placed:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            at, parts = 0, []
            for column, lines, across in row:
                parts += [" " * min(widths.get(c, 0), WIDEST_CELL) for c in range(at, column)]
                width = sum(widths.get(c, 0) for c in range(column, column + across)) + 3 * (across - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(min(width, 4 * WIDEST_CELL)))
                at = column + across
            out.append(" | ".join(parts).rstrip())
    return out


def _walk(node: Node, page: _Page, level: int) -> None:
    """Puts the shown content of ``node`` on the page; only lists, tables and quotes are laid out by calls of their own."""
    nothing = lambda: None
    stack = [(node, iter(node.children), nothing)]
    while stack:
        parent, children, finish = stack[-1]
        child = next(children, None)
        if child is None:
            finish()
            stack.pop()
            continue
        if isinstance(child, str):
            page.text(child)
            continue
        tag = child.tag
        if not _shown(child):
            continue
        around, inner = nothing, None
        if tag == "br":
            if page.line:
                page.end_line()
            elif page.lines and page.lines[-1]:
                page.lines.append("")
            continue
        if tag in ("pre", "xmp", "textarea"):
            around, text = page.paragraph, _plain(child)
            inner = text.strip("\n").split("\n") if text.strip() else []
        elif tag == "img":
            page.text(unescape(_attribute(child, "alt") or ""))
            continue
        elif tag == "input":
            page.text(unescape(_attribute(child, "value") or ""))
            continue
        elif tag in ("ul", "ol", "menu"):
            around = page.paragraph if parent.tag != "li" else page.end_line
            inner = _list(child, level + 1) if level < LAYOUT_LEVELS else None
        elif tag == "table":
            around = page.paragraph
            inner = _table(child, level + 1) if level < LAYOUT_LEVELS else None
        elif tag in ("blockquote", "dd"):
            around = page.paragraph if tag != "dd" else page.end_line
            inner = ["  " + x if x else x for x in _lines(child, level + 1)] if level < LAYOUT_LEVELS else None
        elif tag in PARAGRAPHS:
            around = page.paragraph
        elif tag in BLOCKS:
            around = page.end_line
        elif tag in ("td", "th", "text"):
            around = page.gap
        around()
        if inner is None:
            stack.append((child, iter(child.children), around))
        else:
            page.block(inner)
            around()


def _plain(node: Node) -> str:
    out, stack = [], [iter(node.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            out.append(child)
        elif child.tag == "br":
            out.append("\n")
        elif _shown(child):
            stack.append(iter(child.children))
    return "".join(out)


def _lines(node: Node, level: int = 0) -> list[str]:
    page = _Page()
    _walk(node, page, level)
    page.end_line()
    return page.lines


def render(html: str | None) -> str | None:
    """The visible text of a page."""
    if html is None:
        return None
    tree = parse(html)
    return "\n".join(_lines(_leave_visible(tree) if _VISIBILITY.search(html) else tree))


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the text in a column of its own (replaced if there)."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != out]
    source = pages.select(*[pages[f"`{c}`"] for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(html).to_pylist()
            for a, b in slices(bodies):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(map(render, bodies[a:b]), pa.string())], names=[*kept, out])

    return source.mapInArrow(run, f"{schema}, `{out}` string")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages.select("page_id", "html")).select("page_id", "text")
