"""HTML to text as it is laid out: a tree builder with implied tags, visibility rules, block spacing, lists and aligned tables.

The page is tokenised by the standard parser; `Tree` opens and closes elements as a browser would (a new `li` ends the one before, a block ends
`p`, `tr` and `td` appear where they are left out); `render` walks the tree without recursion and writes all visible text: inline text with
collapsed blanks, blocks on their own lines, a blank line around paragraphs, list marks with indents, `pre` as it stands, and table cells padded
to the width of their column.

Hidden are: head, script, style, template, noscript, the attribute `hidden`, `display:none` and (unless a descendant sets it back)
`visibility:hidden` in `style` attributes or in rules of `<style>` with plain tag, class or id selectors.

One map pass, one page at a time: no shuffle, no state between pages.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements without content, elements ended by a new one, block elements, elements with a blank line around, never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre table figure hr fieldset".split())
UNSEEN = frozenset("head script style template noscript title meta link audio video canvas svg iframe object datalist".split())
ENDS = {  # tag: (open elements it ends, elements at which the search stops)
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"caption", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"caption", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - {"html", "body", "option", "legend", "summary", "tbody", "tfoot", "thead", "tr", "caption"}
WALLS = frozenset("table td th button caption object".split())  # an element inside does not end a `p` outside
_BLANK = re.compile(r"[ \t\n\r\f\v]+")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"[.#]?[A-Za-z_][\w-]*")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.hidden: dict[str, str] = {}  # selector: none or hidden
        self.depth: dict[str, int] = {}  # open elements by tag

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        self.at = node
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def close_to(self, node: Node) -> None:
        """Close everything open up to and with `node`."""
        while self.at is not node.parent:
            self.depth[self.at.tag] -= 1
            self.at = self.at.parent

    def nearest(self, tags, walls) -> Node | None:
        if not any(self.depth.get(t) for t in tags):
            return None
        node = self.at
        while node.parent is not None and node.tag not in walls:
            if node.tag in tags:
                return node
            node = node.parent
        return node if node.tag in tags else None

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body") and self.depth.get(tag):
            return
        if tag in ENDS:
            tags, walls = ENDS[tag]
            while (old := self.nearest(tags, walls)) is not None:
                self.close_to(old)
        if tag in ENDS_P and (old := self.nearest({"p"}, WALLS)) is not None:
            self.close_to(old)
        if tag in ("td", "th") and self.at.tag in ("table", "tbody", "thead", "tfoot"):
            self.open("tr", {})
        self.open(tag, attrs)
        if tag in VOID:
            self.close_to(self.at)

    def handle_endtag(self, tag):
        if tag in VOID or not self.depth.get(tag):
            if tag == "p":  # an end tag alone makes an empty paragraph
                self.handle_starttag("p", [])
                self.close_to(self.at)
            elif tag == "br":
                self.handle_starttag("br", [])
            return
        walls = {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else {"td", "th"} if tag not in ("table", "body", "html") else set()
        if (old := self.nearest({tag}, walls)) is not None:
            self.close_to(old)

    def handle_data(self, data):
        if self.at.tag == "style":
            for selectors, body in _RULE.findall(data):
                how = "none" if _DISPLAY.search(body) else (m := _VISIBILITY.search(body)) and m[1].lower()
                for selector in selectors.split(",") if how else ():
                    if _SELECTOR.fullmatch(selector.strip()):
                        self.hidden[selector.strip().lower()] = how
        self.at.children.append(data)


class Flow:
    """Lines of text being written; `indent` goes before every line, `mark` replaces its end once."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indents: list[str] = []
        self.mark, self.gap, self.blank = "", False, False

    def text(self, data: str) -> None:
        words = _BLANK.sub(" ", data)
        if words and (not self.now or self.blank):
            words = words.lstrip(" ") if not self.now else " " + words.lstrip(" ")
        if words.strip(" "):
            self.blank = words.endswith(" ")
            self.now.append(words[:-1] if self.blank else words)
        elif words and self.now:
            self.blank = True

    def line(self) -> None:
        if self.now or self.mark:
            self.put("".join(self.now))
        self.now, self.blank = [], False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        indent = "".join(self.indents)
        if self.mark:
            indent = indent[: len(indent) - len(self.mark)] + self.mark
        self.lines.append((indent + line).rstrip(" "))
        self.gap, self.mark = False, ""

    def space(self) -> None:
        self.line()
        self.gap = bool(self.lines)


def aligned(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of cells (text, columns spanned) as lines with every column padded to its widest cell; cells may have several lines."""
    widths: dict[int, int] = {}
    placed = []
    for row in rows:
        at, cells = 0, []
        for text, span in row:
            lines = text.split("\n")
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines)))
            cells.append((at, span, lines))
            at += span
        placed.append(cells)
    out = []
    for cells in placed:
        for i in range(max((len(c[2]) for c in cells), default=0)):
            pieces = []
            for at, span, lines in cells:
                width = sum(widths.get(at + k, 0) for k in range(span)) + 2 * (span - 1)
                pieces.append((lines[i] if i < len(lines) else "").ljust(width))
            out.append("  ".join(pieces).rstrip(" "))
    return out


def _span(node: Node) -> int:
    value = node.attrs.get("colspan", "1").strip()
    return min(100, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 5 else 1


def _visibility(node: Node, rules: dict[str, str], shown: bool) -> bool | None:
    """None: the whole subtree is out; else whether its own text is visible."""
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return None
    hows = [rules.get(node.tag)] if rules else []
    if rules:
        hows += [rules.get("." + c.lower()) for c in node.attrs.get("class", "").split()] + [rules.get("#" + node.attrs.get("id", "").lower())]
    style = node.attrs.get("style", "")
    if "none" in hows or _DISPLAY.search(style):
        return None
    m = _VISIBILITY.search(style)
    how = m[1].lower() if m else next((h for h in reversed(hows) if h), None)
    return shown if how is None else how == "visible"


def render(tree: Tree) -> str:
    flows, tables, lists = [Flow()], [], []
    stack: list[tuple[Node | str, bool, bool, bool]] = [(tree.root, False, True, False)]  # node, leaving it, shown, inside pre
    while stack:
        node, leaving, shown, pre = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not shown:
                continue
            if pre:
                first, *rest = node.split("\n")
                flow.now.append(first)
                for part in rest:
                    flow.put("".join(flow.now))
                    flow.now = [part] if part else []
            else:
                flow.text(node)
            continue
        tag = node.tag
        if not leaving:
            seen = _visibility(node, tree.hidden, shown) if tag else shown
            if seen is None:
                continue
            if tag == "br":
                flow.put("".join(flow.now))
                flow.now, flow.blank = [], False
                continue
            if tag in SPACED and not (lists and tag in ("ul", "ol", "menu")):
                flow.space()
            elif tag in BLOCK:
                flow.line()
            if tag == "hr":
                continue
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if start.lstrip("-").isascii() and start.lstrip("-").isdigit() and len(start) < 9 else 1])
            elif tag == "li":
                mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                if lists:
                    lists[-1][1] += 1
                flow.indents.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("dd", "blockquote"):
                flow.indents.append("    " if tag == "dd" else "  ")
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1]:
                flows.append(Flow())
            stack.append((node, True, seen, pre))
            inner = pre or tag in ("pre", "textarea", "listing")
            children = node.children
            if inner and not pre and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            stack.extend((c, False, seen, inner) for c in reversed(children))
            continue
        if tag in ("td", "th") and tables and tables[-1] and len(flows) > 1:
            flow.line()
            flows.pop()
            tables[-1][-1].append(("\n".join(flow.lines).strip("\n"), _span(node)))
        elif tag == "table":
            flow.line()
            for line in aligned(tables.pop()):
                flow.put(line)
            flow.space()
        elif tag in SPACED and not (len(lists) > 1 and tag in ("ul", "ol", "menu")):
            flow.space()
        elif tag in BLOCK:
            flow.line()
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            flow.mark = ""
            flow.indents.pop()
    flows[0].line()
    return "\n".join(flows[0].lines).strip("\n")


def extract(html: str | None) -> str:
    """Visible text of a page; null, empty or text-less pages give an empty text."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return render(tree)


def _texts(batches):
    for batch in batches:
        texts = [extract(h.as_py()) for h in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"])


def html_texts(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, html): page_id, text, n_chars. Repeated rows, null ids and broken mark-up are answered like any other."""
    return pages.selectExpr("cast(page_id as long) as page_id", "cast(html as string) as html").mapInArrow(_texts, "page_id long, text string, n_chars long")
