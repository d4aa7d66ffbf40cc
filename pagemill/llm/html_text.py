"""HTML extraction by layout-aware rendering: all visible text, laid out as a page shows it.

A tolerant tree builder supplies the end tags that HTML leaves out (p, li, dt, dd, option,
table parts) and closes what is left open.  Rendering then walks the visible tree: blocks
begin on new lines, and those with margins after an empty line; lists get indented markers
and numbers; preformatted text keeps its white space; the cells of a table are aligned in
columns, with spans; other white space collapses, across elements too.

Not visible are: head matter, scripts, styles, templates and embedded fallbacks; elements
with ``hidden``, ``display:none`` or ``visibility:hidden``, also by a style sheet's plain
tag, class or id selectors, but for rules of other media than screens; hidden inputs; closed
dialogs, and closed details but for their summary.  An image shows its alternative text, a
drawing its text elements, a formula its text.

Defined cases: a null or empty page gives an empty text; a page without markup is its own
collapsed text; text after an unclosed comment, script or style is part of it; elements may
lie in one another to any depth, but indents stop growing at 80 columns; repeated rows are
rendered alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

INDENT = 80  # columns at which indents stop growing
_TAG = re.compile(r"""<(?:!--|(?P<odd>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>)""")
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_HIDES = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)
_SPACES = re.compile(r"[ \t\n\r\f]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_UNSEEN = frozenset("head script style template title meta link base noscript iframe noembed noframes datalist object audio video canvas param source track area map annotation annotation-xml".split())
_MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp plaintext table figure hr menu fieldset".split())
_BLOCK = _MARGIN | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main nav optgroup option search section summary tr caption".split())
_ENDS_P = _BLOCK - {"html", "body", "option", "optgroup", "tr", "caption"}
#: What an opening tag closes, and the elements that such closing doesn't look beyond.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    **{x: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, set()),
}
_SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "template"})
_FOREIGN = ("svg", "math")
_HEAD = frozenset("head title base link meta style script noscript template".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if "=" in text or text.strip(" \t\r\n/"):
        for name, a, b, c in _ATTR.findall(text):
            found.setdefault(name.lower(), unescape(a or b or c))
    return found


def build(html: str) -> tuple[Node, list[str]]:
    """(root of the tree, texts of its style sheets)."""
    root = Node("#root", {})
    stack, sheets, at, n = [root], [], 0, len(html)
    p_at = [-1]  # for each open element, the place of the p that a block in it would end
    opened: Counter[str] = Counter()
    tag_of = _TAG

    def close(to: int) -> None:
        opened.subtract(x.tag for x in stack[to:])
        del stack[to:], p_at[to:]

    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            text = html[at:begin]
            if stack[-1].tag == "head" and not text.isspace():
                close(len(stack) - 1)
            stack[-1].kids.append(unescape(text) if "&" in text else text)
        if begin == n:
            break
        m = tag_of.match(html, begin)
        if m is None and tag_of is _TAG:  # a quote that never ends: from here on quotes don't count
            m = _LOOSE.match(html, begin)
            if m is not None:
                tag_of = _LOOSE
        if m is None:
            if html.startswith(("<!", "<?"), begin):
                end = html.find("-->" if html.startswith("<!--", begin) else ">", begin)
                at = n if end < 0 else end + (3 if html.startswith("<!--", begin) else 1)
            else:
                stack[-1].kids.append("<")
                at = begin + 1
            continue
        name = m["name"]
        if name is None:
            comment = html.startswith("<!--", begin)
            end = html.find("-->" if comment else ">", begin + 2)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        name, at = name.lower(), m.end()
        if m["end"]:
            if name in ("p", "br") and not opened[name]:
                stack[-1].kids.append(Node(name, {}))
                continue
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k].tag == name:
                    close(k)
                    break
                if stack[k].tag == "table" and name not in ("table", "body", "html"):
                    break
            continue
        if name in ("html", "body") and opened[name]:
            continue
        if name not in _HEAD:
            if stack[-1].tag == "head":
                close(len(stack) - 1)
        if name in _CLOSES:
            ends, bounds = _CLOSES[name]
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ends:
                    close(k)
                    if name not in ("tr", "thead", "tbody", "tfoot"):
                        break
        if name in _ENDS_P and p_at[-1] > 0:
            close(p_at[-1])
        node = Node(name, _attributes(m["attrs"]))
        stack[-1].kids.append(node)
        if name in _VOID:
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(html, at) if name != "plaintext" else None
            text = html[at : end.start() if end else n]
            node.kids.append(unescape(text) if name in ("textarea", "title") else text)
            if name == "style":
                sheets.append(text)
            if end is None:
                break
            close_at = html.find(">", end.end())
            at = n if close_at < 0 else close_at + 1
        elif not m["attrs"].rstrip().endswith("/") or not (name in _FOREIGN or any(opened[x] for x in _FOREIGN)):
            p_at.append(len(stack) if name == "p" else -1 if name in _SCOPE else p_at[-1])
            stack.append(node)
            opened[name] += 1
    return root, sheets


def _screen_rules(sheet: str) -> str:
    """The sheet without comments and without blocks of other media than screens; other at-blocks are opened."""
    sheet, out, at = re.sub(r"/\*.*?\*/", "", sheet, flags=re.DOTALL), [], 0
    for m in re.finditer(r"@([\w-]+)([^{};]*)([{;])", sheet):
        if m.start() < at:
            continue
        out.append(sheet[at : m.start()])
        at = m.end()
        if m[3] == "{":
            at = _block_end(sheet, at)
            media = m[2].lower()
            if m[1].lower() in ("media", "supports", "layer", "container") and ("screen" in media or "all" in media.split() or not re.search(r"\b(?:print|speech)\b", media)):
                out.append(_screen_rules(sheet[m.end() : at - 1]))
    return "".join([*out, sheet[at:]])


def _block_end(sheet: str, at: int) -> int:
    depth = 1
    for m in re.finditer(r"[{}]", sheet[at:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return at + m.end()
    return len(sheet)


def hidden_selectors(sheets: list[str]) -> frozenset[str]:
    """Plain selectors (tag, .class, #id) whose rules hide."""
    found = set()
    for sheet in sheets:
        if "none" in sheet or "hidden" in sheet or "collapse" in sheet:
            for selectors, body in _RULE.findall(_screen_rules(sheet)):
                if _HIDES.search(body):
                    found.update(x for x in map(str.strip, selectors.lower().split(",")) if re.fullmatch(r"[.#]?[\w-]+", x))
    return frozenset(found)


def visible(node: Node, hides: frozenset[str]) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in _UNSEEN:
        return False
    if attrs:
        if "hidden" in attrs or ("style" in attrs and _HIDES.search(attrs["style"])):
            return False
        if tag == "input" and attrs.get("type", "").lower() == "hidden":
            return False
        if hides and (("id" in attrs and f"#{attrs['id'].lower()}" in hides) or any(f".{c}" in hides for c in attrs.get("class", "").lower().split())):
            return False
    if tag == "dialog" and "open" not in attrs:
        return False
    return tag not in hides


class Flow:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap, self.space, self.indent, self.marker = 0, False, 0, ""

    def want(self, lines: int) -> None:
        """The next text begins after so many line ends."""
        self.gap = max(self.gap, lines)
        self.space = False

    def _open(self) -> None:
        if self.gap:
            if self.parts:
                self.parts.append("\n" * self.gap)
            self.gap, self.space = 0, False
            if self.marker:
                self.parts.append(" " * min(INDENT, self.indent - len(self.marker)) + self.marker)
                self.marker = ""
            elif self.indent:
                self.parts.append(" " * min(INDENT, self.indent))
        elif self.space:
            self.parts.append(" ")
            self.space = False

    def text(self, text: str) -> None:
        if "\n" in text or "  " in text or "\t" in text or "\r" in text or "\f" in text:
            text = _SPACES.sub(" ", text)
        if not text:
            return
        if text == " ":
            self.space = self.space or (not self.gap and bool(self.parts))
            return
        if text[0] == " ":
            self.space = self.space or (not self.gap and bool(self.parts))
            text = text[1:]
        trailing = text[-1] == " "
        self._open()
        self.parts.append(text[:-1] if trailing else text)
        self.space = trailing

    def lines(self, text: str) -> None:
        """Text whose white space and line ends stay."""
        for k, line in enumerate(text.split("\n")):
            if k:
                self.gap += 1
                self.space = False
            if line:
                self._open()
                self.parts.append(line)

    def line_end(self) -> None:
        self.gap, self.space = self.gap + 1 if self.parts else 0, False


def run(job: Generator):
    """Runs a generator that yields the generators it waits for; nesting takes no Python stack."""
    waiting, value = [job], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return value


def render(node: Node, flow: Flow, hides: frozenset[str], pre: bool = False) -> Generator:
    for kid in node.kids:
        if isinstance(kid, str):
            flow.lines(kid.replace("\r\n", "\n")) if pre else flow.text(kid)
        elif visible(kid, hides):
            yield _element(kid, flow, hides, pre)


def _drawing(node: Node, flow: Flow, hides: frozenset[str]) -> Generator:
    """Only a drawing's text elements and embedded pages show text."""
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag not in ("defs", "desc", "metadata", "symbol") and visible(kid, hides):
            if kid.tag in ("text", "foreignobject"):
                flow.want(1)
                yield render(kid, flow, hides)
                flow.want(1)
            else:
                yield _drawing(kid, flow, hides)


def _element(node: Node, flow: Flow, hides: frozenset[str], pre: bool) -> Generator:
    tag = node.tag
    if tag == "br":
        flow.line_end()
    elif tag == "hr":
        flow.want(2)
    elif tag == "img" or (tag == "input" and node.attrs.get("type", "").lower() == "image"):
        flow.text(node.attrs.get("alt", ""))
    elif tag == "input":
        if node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "password", "file"):
            flow.text(node.attrs.get("value", ""))
    elif tag == "svg":
        yield _drawing(node, flow, hides)
    elif tag == "table":
        flow.want(2)
        yield _table(node, flow, hides)
        flow.want(2)
    elif tag in ("ul", "ol", "menu", "dir"):
        yield _list(node, flow, hides)
    elif tag == "details" and "open" not in node.attrs:
        flow.want(1)
        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag == "summary":
                yield render(kid, flow, hides)
                break
        flow.want(1)
    elif tag in _BLOCK:
        lines = 2 if tag in _MARGIN else 1
        flow.want(lines)
        held = flow.indent
        if tag == "dd" or tag == "blockquote":
            flow.indent += 2
        yield render(node, flow, hides, pre or tag in ("pre", "xmp", "plaintext"))
        flow.indent = held
        flow.want(lines)
    elif tag == "q":
        flow.text('"')
        yield render(node, flow, hides, pre)
        flow.space = False
        flow.text('"')
    else:
        yield render(node, flow, hides, pre or tag == "textarea")


def _number(text: str | None, otherwise: int, most: int = 10**9) -> int:
    m = re.match(r"\s*([+-]?\d{1,10})", text or "")
    return max(-most, min(most, int(m[1]))) if m else otherwise


def _list(node: Node, flow: Flow, hides: frozenset[str]) -> Generator:
    outer = flow.indent
    gap = 1 if outer else 2
    flow.want(gap)
    number = _number(node.attrs.get("start"), 1)
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "li":
            if not visible(kid, hides):
                continue
            number = _number(kid.attrs.get("value"), number)
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            flow.want(1)
            flow.indent, flow.marker = outer + len(marker), marker
            yield render(kid, flow, hides)
            flow.indent, flow.marker = outer, ""
            flow.want(1)
        elif isinstance(kid, Node):
            if visible(kid, hides):
                yield _element(kid, flow, hides, False)
        elif not kid.isspace():
            flow.text(kid)
    flow.want(gap)


def _rows(node: Node, hides: frozenset[str], loose: list) -> Iterator[Node]:
    todo = node.kids[::-1]
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            if not kid.isspace():
                loose.append(kid)
        elif visible(kid, hides):
            if kid.tag == "tr":
                yield kid
            elif kid.tag in ("thead", "tbody", "tfoot"):
                todo += kid.kids[::-1]
            elif kid.tag in ("td", "th"):
                row = Node("tr", {})
                row.kids.append(kid)
                yield row
            elif kid.tag not in ("colgroup", "col"):
                loose.append(kid)


def _lines_of(node: Node, hides: frozenset[str]) -> Generator:
    flow = Flow()
    yield render(node, flow, hides)
    return "".join(flow.parts).split("\n")


def _table(node: Node, flow: Flow, hides: frozenset[str]) -> Generator:
    """Captions and stray content first, then rows with their cells in columns."""
    loose: list = []
    grid: list[dict[int, tuple[list[str], int]]] = []
    spans: dict[int, int] = {}  # column: rows that a cell from above still covers
    for row in _rows(node, hides, loose):
        cells, column = {}, 0
        for kid in row.kids:
            if isinstance(kid, str) or not visible(kid, hides):
                continue
            while spans.get(column, 0) > 0:
                column += 1
            width = max(1, _number(kid.attrs.get("colspan"), 1, 1000))
            height = max(1, _number(kid.attrs.get("rowspan"), 1, 65534))
            cells[column] = ((yield _lines_of(kid, hides)), width)
            for k in range(column, column + width):
                spans[k] = height if height > 1 else 1
            column += width
        spans = {k: v - 1 for k, v in spans.items() if v > 1}
        grid.append(cells)
    for item in loose:
        if isinstance(item, str):
            flow.text(item)
        else:
            yield _element(item, flow, hides, False)
            flow.want(1)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, (lines, width) in cells.items():
            if width == 1:
                widths[column] = max(widths.get(column, 0), *map(len, lines))
    columns = sorted(set(widths) | {c for cells in grid for c in cells})
    place, at = {}, 0
    for column in columns:
        place[column] = at
        at += widths.get(column, 0) + 2
    for cells in grid:
        flow.want(1)
        for k in range(max((len(lines) for lines, _ in cells.values()), default=0)):
            line = ""
            for column, (lines, _) in cells.items():
                if k < len(lines) and lines[k]:
                    gap = place[column] - len(line)
                    line += " " * (gap if gap > 0 or not line else 2) + lines[k]
            if k:
                flow.gap += 1
            if line.strip():
                flow._open()
                flow.parts.append(line.rstrip())
        flow.want(1)


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    root, sheets = build(html)
    flow = Flow()
    run(render(root, flow, hidden_selectors(sheets)))
    return "".join(flow.parts)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [visible_text(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text of each row of ``pages``; no row moves."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
