"""HTML pages to Markdown, with titles and links.

The page is parsed into a plain tree without implied end tags: an element stays open until its own end tag or that of an
element around it. The main area is rendered block by block: toggles of collapsible parts become headings, tables
become Markdown tables, page furniture goes. A page without a main area is rendered from its body (a stand-in for a
learned extractor, which may choose less).

Defined results: a null or empty page has an empty title and text and no links; a colspan that is no number counts as
one; repeated rows give repeated results; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import py_clean, py_table, py_tidy
from ..functions.urls import classified

# Element names, class patterns, selectors in order of preference.
VOID = set("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
HIDDEN_TEXT = {"script", "style", "template"}
DROPPED = set("script style noscript template svg img picture video audio iframe canvas form input select textarea nav header footer".split())
DROPPED_CLASS = re.compile(r"(?:^|[-_ ])(?:share|social|breadcrumb|skip-link|print|favorite|rating)(?:$|[-_ ])", re.I)
TOGGLE_CLASS = re.compile("accordion__toggle|accordion-button|accordion-header|tab-title|tabs__tab|toggle-title|expand-title", re.I)
HEADINGS = {f"h{n}": n for n in range(1, 7)}
BLOCKS = set("p div section article main aside ul ol li table blockquote dl dt dd pre figure figcaption details summary hr address button".split()) | set(HEADINGS)
TOGGLE_LEVEL = 3
#: Elements nested deeper lend their text to the one that holds them.
DEPTH = 400


class Node:
    """An element: its children are nodes and strings."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        queue = [c for c in reversed(self.children) if isinstance(c, Node)]
        while queue:
            node = queue.pop()
            yield node
            queue.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        """All strings below, in document order; those of scripts, styles and templates only if they are asked themselves."""
        queue: list = list(reversed(self.children))
        while queue:
            item = queue.pop()
            if isinstance(item, str):
                yield item
            elif item.name not in HIDDEN_TEXT:
                queue.extend(reversed(item.children))

    def text(self) -> str:
        return py_clean(" ".join(self.strings()))

    def below(self, *names: str) -> list[Node]:
        """The children of these names."""
        return [c for c in self.children if isinstance(c, Node) and c.name in names]

    def within(self, name: str) -> Node | None:
        """The nearest element of this name around."""
        node = self.parent
        while node is not None and node.name != name:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)
        self.open: dict[str, int] = {}
        self.flat: dict[str, int] = {}
        self.depth = 0
        self.cut = False

    def handle_starttag(self, tag, attrs):
        if self.depth >= DEPTH and tag not in VOID:
            self.flat[tag] = self.flat.get(tag, 0) + 1
            return
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node
            self.depth += 1
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.flat.get(tag):
            self.flat[tag] -= 1
            return
        if not self.open.get(tag):
            return
        found = False
        while not found:
            found = self.now.name == tag
            self.open[self.now.name] -= 1
            self.depth -= 1
            self.now = self.now.parent

    def handle_data(self, data):
        held = self.now.children
        if held and isinstance(held[-1], str) and not self.cut:
            held[-1] += data
        else:
            held.append(data)
        self.cut = False

    def _between(self, _):
        self.cut = True

    handle_comment = handle_decl = handle_pi = unknown_decl = _between


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


# --- the parts of a page ------------------------------------------------------------------------------------------------

MAIN: list[Callable[[Node], bool]] = [
    lambda n: n.name == "main",
    lambda n: n.attrs.get("role") == "main",
    lambda n: n.name == "article",
    lambda n: n.attrs.get("id") == "content",
    lambda n: "content" in n.classes,
]


def title_of(root: Node, suffixes: tuple[str, ...] = ()) -> str:
    """The first h1, or else the title without a site's name at its end."""
    first = next((n for n in root.walk() if n.name == "h1"), None)
    if first is not None and (heading := first.text()):
        return heading
    named = next((n for n in root.walk() if n.name == "title"), None)
    text = "".join(named.strings()).strip() if named is not None else ""
    for suffix in suffixes:
        text = re.sub(rf"\s+[-|–]\s+{re.escape(suffix)}\s*\Z", "", text)
    return text


def main_area(root: Node) -> Node | None:
    """The first match of the first selector whose first match has text."""
    for wanted in MAIN:
        first = next(filter(wanted, root.walk()), None)
        if first is not None and first.text():
            return first
    return None


def is_toggle(node: Node) -> bool:
    return bool(TOGGLE_CLASS.search(" ".join(node.classes))) or node.name == "button" and "aria-controls" in node.attrs


def _is_noise(node: Node) -> bool:
    return node.name in DROPPED or bool(DROPPED_CLASS.search(" ".join(node.classes))) or node.name == "button" and not is_toggle(node)


def strip_noise(root: Node) -> None:
    """Takes page furniture out of what is below `root`."""
    queue = [root]
    while queue:
        node = queue.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _is_noise(c)]
        queue.extend(c for c in node.children if isinstance(c, Node))


# --- rendering ----------------------------------------------------------------------------------------------------------


def _heading(level: int, node: Node) -> str:
    text = node.text()
    return f"{'#' * level} {text}" if text else ""


def _class_level(node: Node) -> int:
    return next((int(c[1]) for c in node.classes if re.fullmatch(r"h[1-6]", c)), 0)


def list_lines(node: Node, depth: int = 0) -> list[str]:
    """A list's items, those of lists right inside them indented."""
    out = []
    for number, item in enumerate(node.below("li"), 1):
        inner = item.below("ul", "ol")
        own = Node(item.name, item.attrs, None)
        own.children = [c for c in item.children if not any(c is x for x in inner)]
        if text := own.text():
            out.append(f"{'  ' * depth}{f'{number}.' if node.name == 'ol' else '-'} {text}")
        for x in inner:
            out.extend(list_lines(x, depth + 1))
    return out


def _span(cell: Node) -> int:
    try:
        return max(int(cell.attrs.get("colspan") or 1), 1)
    except ValueError:
        return 1


def table_markdown(table: Node) -> str:
    """The rows of this table, not of tables within. The head is the first row in a thead or of th cells alone, or else
    the first row."""
    head, rows = None, []
    for tr in table.walk():
        if tr.name != "tr" or tr.within("table") is not table:
            continue
        cells = tr.below("th", "td")
        row = [t for c in cells for t in [c.text()] * _span(c)]
        if not row:
            continue
        is_head = tr.within("thead") is not None or all(n.name == "th" for n in tr.walk() if n.name in ("th", "td"))
        if head is None and is_head:
            head = row
        else:
            rows.append(row)
    if head is None:
        if not rows:
            return ""
        head, *rows = rows
    caption = next((n.text() for n in table.walk() if n.name == "caption"), "")
    return f"**{caption}**\n\n{py_table(head, rows)}" if caption else py_table(head, rows)


def _definitions(node: Node) -> str:
    marks = {"dt": "**{}**", "dd": ": {}"}
    return "\n".join(marks[c.name].format(t) for c in node.below("dt", "dd") if (t := c.text()))


def _quoted(node: Node) -> str:
    return "\n".join(">" + (line and f" {line}") for line in render(node).splitlines())


_RENDERED: dict[str, Callable[[Node], str]] = {
    "summary": lambda n: _heading(TOGGLE_LEVEL, n),
    "p": lambda n: _heading(_class_level(n), n) if _class_level(n) else n.text(),
    "ul": lambda n: "\n".join(list_lines(n)),
    "ol": lambda n: "\n".join(list_lines(n)),
    "table": table_markdown,
    "dl": _definitions,
    "blockquote": _quoted,
    "pre": lambda n: f"```\n{''.join(n.strings()).strip()}\n```",
    "hr": lambda n: "",
}


def block(node: Node) -> str:
    """One block-level element as Markdown."""
    if node.name in HEADINGS:
        return _heading(HEADINGS[node.name], node)
    if is_toggle(node):
        return _heading(TOGGLE_LEVEL, node)
    if node.name in _RENDERED:
        return _RENDERED[node.name](node)
    level = _class_level(node)
    return _heading(level, node) if level else render(node)


def render(node: Node) -> str:
    """What is below: runs of inline content and blocks, with blank lines between."""
    out: list[str] = []
    inline: list[str] = []
    for child in [*node.children, None]:
        if isinstance(child, str):
            inline.append(child)
        elif child is not None and child.name not in BLOCKS:
            inline.extend(child.strings())
        else:
            out.append(py_clean(" ".join(inline)))
            inline = []
            if child is not None:
                out.append(block(child))
    return "\n\n".join(filter(None, out))


def extract(page: str | None, url: str | None, suffixes: tuple[str, ...] = ()) -> dict:
    """(title, markdown, child_links, pdf_links) of a page."""
    root = parse(page or "")
    title, area = title_of(root, suffixes), main_area(root)
    if area is None:
        area = next((n for n in root.walk() if n.name == "body"), root)
        hrefs = [n.attrs["href"] for n in area.walk() if n.name == "a" and "href" in n.attrs]
        strip_noise(area)
    else:
        strip_noise(area)
        hrefs = [n.attrs["href"] for n in area.walk() if n.name == "a" and "href" in n.attrs]
    pages, pdfs = classified(hrefs, url or "")
    return {"title": title, "markdown": py_tidy(render(area)), "child_links": pages, "pdf_links": pdfs}


def hrefs(page: str | None, tag: str = "body") -> list[str]:
    """Every link's href below the first element of this name, in order."""
    root = parse(page or "")
    top = next((n for n in root.walk() if n.name == tag), root)
    return [n.attrs["href"] for n in top.walk() if n.name == "a" and "href" in n.attrs]


def extract_pages(pages: DataFrame, keep: list[str] | None = None, html: str = "html", url: str = "url", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` (the URL if none are named), title, markdown, content_type, child_links, pdf_links of each
    row. Pages are parsed where they are read; nothing is shuffled."""
    keep = [url] if keep is None else keep
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)
    strings = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                got = [extract(h, u, suffixes) for h, u in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:], pa.array([g["title"] for g in got], pa.string()), pa.array([g["markdown"] for g in got], pa.string()), pa.array(["html"] * len(got), pa.string()),
                     pa.array([g["child_links"] for g in got], strings), pa.array([g["pdf_links"] for g in got], strings)],
                    names=[*keep, "title", "markdown", "content_type", "child_links", "pdf_links"],
                )

    return pages.select(html, url, *keep).mapInArrow(run, f"{fields}, title string, markdown string, content_type string, child_links array<string>, pdf_links array<string>")


def page_links(pages: DataFrame, keep: list[str], html: str = "html", tag: str = "body") -> DataFrame:
    """The columns `keep`, pos and href: a row for each link below the first element of this name."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, h) for i, page in enumerate(b.column(0).to_pylist()) for k, h in enumerate(hrefs(page, tag))]
            at, pos, href = zip(*rows, strict=True) if rows else ((), (), ())
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[1:]), pa.array(pos, pa.int32()), pa.array(href, pa.string())], names=[*keep, "pos", "href"])

    return pages.select(html, *keep).mapInArrow(run, f"{fields}, pos int, href string")
