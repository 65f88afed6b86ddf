"""Main-text extraction from whole HTML pages by tag-path ratios.

A page is cut into blocks (runs of inline text between block-level tags), each under its root-to-leaf tag path. For
each path, text length and punctuation are summed over its blocks; a path's ratio is its text length for each block,
weighted by its punctuation for each block and by the share of text outside links. The ratios, laid along the page, are
smoothed with a Gaussian, fused with the raw ones (geometric mean), and paths above a threshold are content paths (Wu
et al., "Web content extraction via tag path feature fusion"). The content node is the innermost element that holds
nearly all text of content paths; its blocks are the article, with the first-level heading before it where it has none.
At its edges, lists of links go whose ratio would stay below the threshold even if links were text; where no element
holds the article apart from the rest of the page, so do all blocks below it.

HTML's own elements for something else (nav, footer, aside, forms' controls, scripts) are never read. What a class name or
an id says is the last resort, for adverts, notices and readers' comments that look like an article to any ratio: such a
part goes unless it holds over half of the page's content-path text and no article or main part stands beside it (comments
go always), or the word is one that articles use for their own parts, the part is text within the article and it is no
series of like parts.

Defined results: a null or empty page, and one with no text block, gives an empty string; unclosed, misnested and cut
tags are closed as browsers do for the common cases; repeated rows give repeated results; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "canvas", "object", "select"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Never content, whatever they hold.
_DROP = set("head script style noscript template svg math canvas object iframe nav aside footer button select textarea input label dialog menu search audio video map frameset".split())
#: What a class name or an id says that its part of the page is, by its last word or, of adverts, its first.
_WORDS = set(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toc sidebar aside footer masthead sponsor sponsored promo promotion promoted "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing social respond response responses discussion "
    "related recommended recommendations trending widget widgets toolbar skip copyright disclaimer feedback hidden".split()
)
_ADVERTS = set("ad ads advert adverts advertisement advertising adsense adslot".split())
#: What readers wrote, which is never the article, however much of a page it is.
_REMARKS = set("comment comments commentlist disqus reply replies".split())
#: Last words that say only that it is a part, and first ones that say only where.
_PLAIN = set("area bar block body box button buttons container content form icons inner items links list message panel posts section slot thread title top bottom left right".split())
#: May hold a whole page: not content unless they hold most of it.
_FORMS = {"form", "fieldset"}
#: Words that articles use for their own parts as well.
_VAGUE = set("discussion notice notices alert response responses feedback".split())
#: Whole class names and ids of what stands above all of a site's pages.
_ABOVE = set("header site-header siteheader main-header global-header topbar top-bar site-title branding".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar"}
#: Elements whose class or id is never taken for a sign of something else.
_TRUSTED = {"html", "body", "main", "article"} | _HEADING | {"p"}
#: A start tag of the key closes an open element of the value.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"thead", "tbody"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "html", "main", "aside", "nav", "footer", "header", "form", "td", "th", "blockquote", "details", "figure"}
#: What can hold an article.
_HOLDERS = {"body", "main", "article", "section", "div", "form", "fieldset", "header", "center", "table", "tbody", "tr", "td"}
#: Elements nested deeper are read as if they stood beside each other, so that their text is kept.
DEPTH = 512
#: How far the smoothing reaches, the threshold as a share of the mean fused ratio of the page's characters, and the share of content text that a content node holds.
KERNEL, THRESHOLD, HOLD = (0.25, 0.5, 0.25), 0.3, 0.75
#: The share of content text above which a subtree is content, whatever it says.
MOST = 0.5


class _Node:
    __slots__ = ("tag", "label", "parent", "path", "drop", "marked", "vague", "remark")

    def __init__(self, tag: str, parent: _Node | None, label: str, drop: bool, marked: bool, vague: bool = False, remark: bool = False):
        self.tag, self.label, self.parent = tag, label, parent
        self.path = hash((parent.path if parent else None, label))  # equal tag paths have equal numbers
        self.drop = drop or bool(parent and parent.drop)
        self.marked, self.vague, self.remark = marked, vague, remark  # by its class, its id or as a form; by vague words alone; as remarks


def _says(tag: str, attrs: str, in_article: bool) -> tuple[str, bool, bool, bool, bool]:
    """The path label, and whether the element is hidden or by its role, or by its class or id, something else, or only
    by vague words, or what readers wrote."""
    if not attrs or not attrs.strip(" /\n\t\r"):
        return tag, False, tag in _FORMS, False, False
    got = {}
    for k, v in _ATTR.findall(attrs):
        got.setdefault(k.lower(), html.unescape(v.strip("\"'")))
    names = f"{got.get('class', '')} {got.get('id', '')}".split()
    hard = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or got.get("role", "").lower() in _ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "").lower()))
    soft = tag in _FORMS or got.get("role", "").lower() == "form"
    vague = remark = False
    for name in names:
        parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]
        if not parts or parts[0] in ("no", "has", "with", "without"):
            continue
        while len(parts) > 1 and (parts[-1] in _PLAIN or parts[-1].isdigit()):
            parts.pop()
        last = parts[-1]
        soft = soft or name.lower() in _ABOVE and not in_article or last in _WORDS - _VAGUE or parts[0] in _ADVERTS or last in _ADVERTS
        vague, remark = vague or last in _VAGUE, remark or last in _REMARKS
    first = names[0] if names else ""
    return (f"{tag}.{first}" if first else tag), hard, soft or vague or remark, vague and not soft and not remark, remark


class _Block:
    __slots__ = ("node", "text", "links", "pre")

    def __init__(self, node: _Node, text: str, links: int):
        self.node, self.text, self.links = node, text, links


def _blocks(page: str) -> list[_Block]:
    root = _Node("html", None, "html", False, False)
    stack: list[_Node] = [root]
    out: list[_Block] = []
    held: list[str] = []
    owner, anchors, linked = root, 0, 0
    in_article = 0
    flat: dict[str, int] = {}

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text and not owner.drop:
                out.append(_Block(owner, text, min(linked, len(text))))
            held = []
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        held.append(text)
        if anchors:
            linked += len(text)

    def block_of() -> _Node:
        for n in reversed(stack):
            if n.tag in _BLOCK:
                return n
        return root

    def pop_to(i: int) -> None:
        nonlocal anchors, owner, in_article
        for n in stack[i:]:
            anchors -= n.tag == "a"
            in_article -= n.tag == "article"
        del stack[i:]
        owner = block_of()

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        if lt > at:
            put(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            put("&lt;")
            at = lt + 1
            continue
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                put(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if close:
            if tag == "br":
                put(" ")
                continue
            if flat.get(tag):
                flat[tag] -= 1
                if tag in _BLOCK:
                    flush()
                continue
            if tag in _BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        flush()
                        pop_to(i)
                        break
                    if tag == "p" and stack[i].tag in _SCOPE or tag == "li" and stack[i].tag in ("ul", "ol"):
                        break
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
                    if stack[i].tag in _BLOCK:
                        break
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if not attrs.endswith("/") or tag in ("script", "style", "textarea", "title", "iframe"):
                at = stop.end() if stop else end
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCK:
            flush()
            if tag not in ("option", "optgroup"):  # a block ends an open paragraph, and what is open in it
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        pop_to(i)
                        break
                    if stack[i].tag in _SCOPE:
                        break
            shut = _CLOSES.get(tag)
            if shut:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in shut:
                        pop_to(i)
                        continue
                    if stack[i].tag in _SCOPE and stack[i].tag not in ("td", "th"):
                        break
            if tag in _HEADING and stack[-1].tag in _HEADING:
                pop_to(len(stack) - 1)
        if tag in ("html", "body") and any(n.tag == tag for n in stack[1:]) or tag == "html":
            continue
        if len(stack) >= DEPTH:
            flat[tag] = flat.get(tag, 0) + 1
            continue
        label, hard, soft, vague, remark = _says(tag, attrs, in_article > 0)
        drop = hard or tag in _DROP or tag == "header" and not in_article
        node = _Node(tag, stack[-1], label, drop, soft and tag not in _TRUSTED, vague, remark and tag not in _TRUSTED)
        stack.append(node)
        anchors += tag == "a"
        in_article += tag == "article"
        if tag in _BLOCK:
            owner = node
    flush()
    return out


def _ratios(blocks: list[_Block], linked: bool = True) -> list[float]:
    """The tag-path ratio of each block; without `linked`, as if links were text like any other."""
    sums: dict[int, list[int]] = {}
    for b in blocks:
        s = sums.setdefault(b.node.path, [0, 0, 0, 0])
        for i, v in enumerate((1, len(b.text), len(_PUNCT.findall(b.text)), b.links)):
            s[i] += v
    ratio = {p: (n / k) * (1 + q / k) * (1 - min(1.0, l / max(n, 1)) * linked) for p, (k, n, q, l) in sums.items()}
    return [ratio[b.node.path] for b in blocks]


def _fused(raw: list[float]) -> list[float]:
    """The ratios along the page, smoothed and fused with themselves."""
    reach = len(KERNEL) // 2
    fused = []
    for i, r in enumerate(raw):
        near = [(raw[i + d], KERNEL[d + reach]) for d in range(-reach, reach + 1) if 0 <= i + d < len(raw)]
        smooth = sum(v * w for v, w in near) / sum(w for _, w in near)
        fused.append((r * smooth) ** 0.5)
    return fused


def _paths(blocks: list[_Block]) -> tuple[set[int], float]:
    """The content paths, and the threshold that they pass: a share of the fused ratio that the page's text has on average."""
    fused = _fused(_ratios(blocks))
    limit = THRESHOLD * sum(f * len(b.text) for b, f in zip(blocks, fused, strict=True)) / sum(len(b.text) for b in blocks)
    sums: dict[int, list[float]] = {}
    for b, f in zip(blocks, fused, strict=True):
        s = sums.setdefault(b.node.path, [0, 0.0])
        s[0] += 1
        s[1] += f
    return {p for p, (k, f) in sums.items() if f > 0 and f >= limit * k}, limit


def _weight(b: _Block, content: set[int]) -> int:
    return len(b.text) - b.links if b.node.path in content and b.node.tag not in _HEADING else 0


def _above(n: _Node | None) -> Iterator[_Node]:
    while n is not None:
        yield n
        n = n.parent


def _content_node(blocks: list[_Block], weights: list[int]) -> _Node:
    """The innermost element that holds HOLD of the content text: down from the root while a child does. Where none does
    before the first choice between parts of the page, the one article or main part that holds any of it."""
    held: dict[int, int] = {}
    children: dict[int, dict[int, _Node]] = {}
    homes: dict[int, _Node] = {}
    for b, w in zip(blocks, weights, strict=True):
        for n in _above(b.node):
            held[id(n)] = held.get(id(n), 0) + w
            if n.tag in ("article", "main") and w:
                homes[id(n)] = n
            if n.parent is not None:
                children.setdefault(id(n.parent), {})[id(n)] = n
    at, total = next(n for n in _above(blocks[0].node) if n.parent is None), sum(weights)
    while total:
        inner = [n for n in children.get(id(at), {}).values() if n.tag in _HOLDERS and held[id(n)] >= HOLD * total]
        if not inner:
            break
        at = inner[0]
    # a cell or a table holds an article only if it lays out the page: a cell with parts of its own
    while at.tag in ("table", "tbody", "tr", "td") and at.parent is not None:
        if at.tag == "td" and sum(c.tag in ("p", "div", "section") or c.tag in _HEADING for c in children.get(id(at), {}).values()) > 1:
            break
        at = at.parent
    if at.tag in ("html", "body"):
        outer = [n for n in homes.values() if not any(m.tag in ("article", "main") for m in _above(n.parent))]
        if len(outer) == 1:
            return outer[0]
    return at


def _title(blocks: list[_Block], inside: list[bool], at: _Node) -> int:
    """The place of the heading before the content node that is its title, or -1: the last first-level one, where the node
    has none."""
    first = inside.index(True)
    if at.tag in ("html", "body") or any(b.node.tag == "h1" for b, x in zip(blocks, inside, strict=True) if x):
        return -1
    return max((i for i in range(first) if blocks[i].node.tag == "h1" and blocks[i].links < len(blocks[i].text)), default=-1)


def _unmarked(blocks: list[_Block]) -> list[_Block]:
    """The last resort for what ratios do not tell from an article: the blocks that stand in no marked subtree, but those
    that the text shows to be content."""
    marks = [[n for n in _above(b.node) if n.marked] for b in blocks]
    if not any(marks):
        return blocks
    content, _ = _paths(blocks)
    weights = [_weight(b, content) for b in blocks]
    homes = {id(n) for b, own in zip(blocks, marks, strict=True) if not own for n in _above(b.node) if n.tag in ("article", "main")}
    held: dict[int, list[int]] = {}  # content text, all text, first and last block
    kinds: dict[int, dict[str, set[int]]] = {}  # the parts of a marked subtree by their labels
    for i, (b, own) in enumerate(zip(blocks, marks, strict=True)):
        for n in own:
            h = held.setdefault(id(n), [0, 0, i, i])
            h[0] += weights[i]
            h[1] += len(b.text)
            h[3] = i
        if own:
            for n in _above(b.node):
                if n.parent is not None and n.tag not in ("p", "pre", "ul", "ol", "table", "figure", "blockquote") and n.tag not in _HEADING:
                    kinds.setdefault(id(n.parent), {}).setdefault(n.label, set()).add(id(n))
    total = sum(weights)
    said = [i for i, w in enumerate(weights) if w] or [0]

    def is_content(n: _Node) -> bool:
        text, whole, first, last = held[id(n)]
        if n.remark:
            return False
        if text > MOST * total and homes <= {id(m) for m in _above(n.parent)}:
            return True
        beside = any(m.tag in ("article", "main") for m in _above(n.parent)) or said[0] < first and last < said[-1]
        return n.vague and text > MOST * whole and beside and all(len(x) < 2 for x in kinds.get(id(n), {}).values())

    verdict: dict[int, bool] = {}
    for own in marks:
        for n in own:
            if id(n) not in verdict:
                verdict[id(n)] = is_content(n)
    return [b for b, own in zip(blocks, marks, strict=True) if all(verdict[id(n)] for n in own)]


def extract(page: str | None) -> str:
    """The main text: one line for each block."""
    kept = _unmarked(_blocks(page or ""))
    if not kept:
        return ""
    content, limit = _paths(kept)
    weights = [_weight(b, content) for b in kept]
    at = _content_node(kept, weights)
    inside = [any(n is at for n in _above(b.node)) for b in kept]
    title = _title(kept, inside, at)
    loose = _fused(_ratios(kept, linked=False))
    said = [i for i, x in enumerate(inside) if x and weights[i]]
    links: dict[int, list[int]] = {}  # of each list: all text, links, first and last block
    lists = [next((n for n in _above(b.node) if n.tag in ("ul", "ol")), None) for b in kept]
    for i, n in enumerate(lists):
        if n is not None:
            s = links.setdefault(id(n), [0, 0, i, i])
            s[0] += len(kept[i].text)
            s[1] += kept[i].links
            s[3] = i
    out = []
    for i, b in enumerate(kept):
        if i == title:
            out.append(b.text)
        if not inside[i]:
            continue
        between = bool(said) and said[0] < i < said[-1]
        if lists[i] is not None and not between:
            text, linked, first, last = links[id(lists[i])]
            if last > first and linked >= 0.9 * text and max(loose[first : last + 1]) < limit:
                continue  # a menu at an edge of the article
        if at.tag in ("html", "body") and said and not between and i not in said and b.node.tag not in _HEADING and loose[i] < limit:
            continue  # nothing holds the article apart from what stands before and after it
        out.append(b.text)
    return "\n".join(out)


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` but those called like a result, text and n_chars for each row of `pages(html)`."""
    keep = [c for c in keep if c.lower() not in ("text", "n_chars")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                text = [extract(x) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*part.schema.names[1:], "text", "n_chars"])

    return pages.select("html", *keep).mapInArrow(run, f"{fields}, text string, n_chars long")


def op6_html_content(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
