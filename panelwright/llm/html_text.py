"""Main text of HTML pages by composite text density.

Every block of a page is a node with its characters, tags, link characters and link tags. A node's density is its
characters per tag, adjusted for links; its sum is that of its children's densities. The node with the greatest sum is
the content, and the least density on its path from the body is the threshold: wherever a node reaches it, the node
of the greatest sum below is content too. Content inside an article or main makes that whole block content, with its
title, lead paragraph and short sections; without one, the highest block around the content with few links does. The body
counts only if headings or paragraphs stand directly in it. Menus, scripts, notices and the like are no part of the tree,
unless they turn out to hold the page's article or most of its text without links (settle).

NULL or empty pages, and pages without text, give an empty text. Pages are judged one by one; repeated rows repeat."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A quote holds a value together only right after the equals sign; elsewhere, and where it is never closed, it is a character.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[^>=]++)*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = set("head nav footer aside form button select option svg canvas object audio video dialog menu header fieldset".split())
# An open block that a new one of these ends.
ENDS = {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
ENDS |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "body", "div", "section", "main", "blockquote"}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-bar|menu|navbar|nav|navigation|breadcrumbs?|footer|header|masthead|"
    r"comments?|commentlist|respond|replies|disqus|cookies?|consent|notice|notification|alert|newsletter|subscribe|signup|social|share|sharing|related|recommended|popup|modal|widget)(?:$|[\s_-])",
    re.I,
)
# Layout words of a class that say what stands beside or how, and headers that are a text's own.
LAYOUT = re.compile(r"(?<!\S)(?:(?:\S*[_-])?(?:has|with|without|no)[_-]\S+|\S+[_-]fixed)(?!\S)", re.I)
OWN_HEADER = re.compile(r"(?<!\S)(?:post|entry|article|story)[_-]header(?!\S)", re.I)
HEADER = re.compile(r"(?<![^\s_-])header(?![^\s_-])", re.I)
# Noise that is someone else's text, however long, and dropped tags that may stand around a whole page.
FOREIGN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|respond|replies|disqus|cookies?|consent|newsletter|subscribe|signup|"
    r"related|recommended|popup|modal)(?:$|[\s_-])",
    re.I,
)
AROUND = {"form", "fieldset", "header", "dialog"}
KEPT, NOISY, ALIEN, PART, SHUT = range(5)  # noise of layout, of others' text, of a page part, and what is never shown or text
NEVER = set("head button select option svg canvas object audio video".split())
HOLDERS = ("article", "main")
FEW_LINKS = 10  # characters for each link character, at least
FLAT = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form"}


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "content", "noise", "dropped", "mute")

    def __init__(self, tag: str, parent: Node | None, noise: int):
        self.tag, self.parent, self.children, self.noise, self.dropped = tag, parent, [], noise, KEPT
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.content = self.mute = False  # mute: kept for blocks inside it alone


def _noise(tag: str, attributes: str, parent: Node) -> int:
    if tag in ("body", "html", *HOLDERS):
        return KEPT
    kind = KEPT
    if tag in DROPPED and not (tag == "header" and _inside(parent, HOLDERS)):
        kind = SHUT if tag in NEVER else NOISY if tag in AROUND else PART
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and NOISE.search(value):
            value = OWN_HEADER.sub(" ", LAYOUT.sub(" ", value))
            if HEADER.search(value) and _inside(parent, HOLDERS):
                value = HEADER.sub(" ", value)
            if NOISE.search(value):
                kind = max(kind, ALIEN if FOREIGN.search(value) else NOISY)
        elif name == "role" and value in NOISE_ROLES:
            kind = max(kind, NOISY if value in ("form", "banner") else PART)
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return SHUT
    return kind


def _inside(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(page: str) -> tuple[Node, list[tuple[Node, int, str]]]:
    """The tree of blocks and, in page order, (block, serial of the stretch without a block border, text)."""
    root = Node("#root", None, KEPT)
    node, texts, serial, at, links, hidden = root, [], 0, 0, 0, 0
    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text and not hidden:
            texts.append((node, serial, text))
            size = sum(map(len, html.unescape(text).split()))
            node.chars += size
            if links:
                node.link_chars += size
        if not found:
            return root, texts
        at = found.end()
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in INLINE or tag in VOID and tag != "hr":
            if tag == "br":
                if not hidden:
                    texts.append((node, serial, " "))
            elif tag == "a":
                links = max(0, links + (-1 if closing else 1))
                node.link_tags += not closing
            if hidden and tag == "span":
                hidden = max(0, hidden + (-1 if closing else 1))
            elif tag == "span" and not closing and _noise(tag, found[3], node):
                hidden = 1
            node.tags += not closing
            continue
        serial += 1
        hidden = links = 0
        if closing:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        ended, up = ENDS.get(tag, ()), node
        while ended and up is not root:
            if up.tag in ended:
                node = up.parent
            elif up.tag in SCOPES:
                break
            up = up.parent
        node.tags += 1
        if tag != "hr":
            child = Node(tag, node, _noise(tag, found[3], node))
            node.children.append(child)
            if not found[3].rstrip().endswith("/"):
                node = child


def settle(root: Node) -> None:
    """Which blocks are dropped. A noisy block stays if an article or main in it has more text than those outside of noise,
    or if it holds most of the page's text without links. Only where no article or main with text is kept, others' text may
    stay for the second reason, and an article or main ends a drop around it. What is never shown stays out."""
    nodes, todo = [], [(root, False)]
    clear = set()  # blocks with no noise around them
    while todo:
        node, noisy = todo.pop()
        noisy = noisy or node.noise != KEPT
        if node.noise != SHUT:
            nodes.append(node)
            if not noisy:
                clear.add(node)
            todo.extend((child, noisy) for child in node.children)
        else:
            _drop(node)
    if len(clear) == len(nodes):
        return
    whole: dict[Node, int] = {}  # characters without links, and of those the ones outside of noise
    clean: dict[Node, int] = {}
    article: dict[Node, int] = {}  # of the article or main with most of them
    for node in reversed(nodes):
        inner = [c for c in node.children if c.noise != SHUT]
        own = node.chars - node.link_chars
        whole[node] = own + sum(whole[c] for c in inner)
        clean[node] = own + sum(clean[c] for c in inner if c.noise == KEPT)
        article[node] = max([article[c] for c in inner] + [clean[node] if node.tag in HOLDERS else 0])
    outside = max((clean[n] for n in clear if n.tag in HOLDERS), default=0)
    for last in (False, True):
        for node in nodes:  # parents come first
            stays = node.noise == KEPT or 2 * whole[node] > whole[root] and (node.noise == NOISY or last and node.noise == ALIEN)
            stays = stays or node.noise == NOISY and article[node] > outside
            around = node.parent.dropped if node.parent else KEPT
            node.dropped = KEPT if last and node.tag in HOLDERS else around or (KEPT if stays else node.noise)
        if any(not n.dropped and n.tag in HOLDERS and clean[n] for n in nodes):
            break
    for node in nodes:
        up = node.parent
        while node.tag in HOLDERS and not node.dropped and up.dropped:
            up.dropped, up.mute = KEPT, True
            up.chars = up.link_chars = up.tags = up.link_tags = 0
            up = up.parent


def _drop(node: Node) -> None:
    todo = [node]
    while todo:
        node = todo.pop()
        node.dropped = SHUT
        todo.extend(node.children)


def _in_order(root: Node) -> list[Node]:
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.dropped:
            nodes.append(node)
            todo.extend(reversed(node.children))
    return nodes


def measure(root: Node) -> list[Node]:
    """Densities and sums of the tree, children before parents; the nodes in page order."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        for child in node.children:
            if not child.dropped:
                node.chars += child.chars
                node.tags += child.tags
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        if node.chars:
            base = math.log(node.chars / max(node.chars - node.link_chars, 1) * node.link_chars + share * node.chars + math.e)
            ratio = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            node.density = node.chars / max(node.tags, 1) * math.log(max(ratio, 1.0)) / math.log(max(base, math.e))
        node.total = sum(child.density for child in node.children if not child.dropped)
    return nodes


def _few_links(node: Node) -> bool:
    return node.link_chars * FEW_LINKS <= node.chars


def _holders(under: list[Node]) -> dict[Node, Node]:
    """For nodes inside an article or main, the outermost; a main with many links gives way to an article in it."""
    top: dict[Node, Node] = {}
    article: dict[Node, Node] = {}
    for node in under:  # parents come first
        for outer, tags in ((top, HOLDERS), (article, HOLDERS[:1])):
            if node.parent in outer:
                outer[node] = outer[node.parent]
            elif node.tag in tags:
                outer[node] = node
    return {n: article[n] if n in article and t.tag == "main" and not _few_links(t) else t for n, t in top.items()}


def _wrapper(node: Node, body: Node) -> Node:
    """The highest block around a node with few links."""
    found = node
    while node is not body:
        node = node.parent
        if _few_links(node) and (node is not body or any(c.tag in FLAT and c.chars and not c.dropped for c in node.children)):
            found = node
    return found


def main_text(page: str | None) -> str:
    root, texts = parse(page or "")
    settle(root)
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    under = _in_order(body)
    best: dict[Node, Node] = {}
    for node in reversed(under):  # the node of the greatest sum at or below each node; the upper one of equals
        top = node
        for child in node.children:
            if not child.dropped and best[child].total > top.total:
                top = best[child]
        best[node] = top
    threshold, node = math.inf, best[body]
    while node is not None:
        threshold = min(threshold, node.density)
        if node is body:
            break
        node = node.parent
    for node in under:
        if node.density >= threshold and node.chars:
            best[node].content = True
    holders = _holders(under)
    for node in under:
        if node.content and node in holders:
            holders[node].content = True
    if best[body] not in holders:
        _wrapper(best[body], body).content = True
    for node in under:
        if node is not body and node.parent.content:
            node.content = True
    blocks: dict[int, list[str]] = {}
    for node, serial, text in texts:
        if node.content and not node.dropped and not node.mute:
            blocks.setdefault(serial, []).append(text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, type=pa.string()), pa.array([len(t) for t in found], type=pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
