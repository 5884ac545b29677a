"""Main text of web pages by tree scoring.

The page becomes a tree.  Parts that are never article text (menus, headers,
footers, side columns, notices, adverts, forms, scripts, reader comments) are
cut by element and role, and by whole class tokens and ids or one unmistakable part of them, unless what is so named
holds the article, is a section of it under a heading, or is most of a page
without an article.  Every block of text then passes points for its
length and commas to its ancestors, less the further up they are, and each
ancestor's points are discounted by the share of its text that is links.  The
container with the most points and those of its siblings that read as text are
kept; a container inside an article stands for the whole article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input iframe "
    "object embed svg canvas audio video map menu dialog label fieldset datalist".split()
)
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 header hgroup address blockquote pre ul ol li dl dt dd "
    "table caption thead tbody tfoot tr td th figure figcaption center details summary hr search nav footer aside form fieldset".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag that ends an open element of the same kind, up to the element that holds both.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
# An end tag does not reach past these.
WALLS = frozenset("table td th article main section body html".split())
# Parts of class tokens and ids that name what is never article text, and words that stand beside them there.
CLUTTER = re.compile(
    r"ads?|adv|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|sidebar|sidenav|"
    r"rail|nav|navbar|navigation|menu|menubar|breadcrumbs?|footer|foot|header|masthead|topbar|comments?|commentlist|disqus|reply|replies|respond|"
    r"discussions?|social|share|sharing|related|recommend(?:ed|ations?)?|newsletter|subscribe|subscriptions?|signup|login|widgets?|toolbar|"
    r"pagination|pager|skiplink|copyright|disclaimer|outbrain|taboola|mostpopular|mostread|latestnews|siteinfo|authorbio|trendingnow"
)
BESIDE = re.compile(
    r"site|page|main|global|top|bottom|left|right|primary|secondary|inner|outer|wrapper|wrap|container|box|bar|list|items?|section|area|block|"
    r"links?|buttons?|icons?|slot|unit|mobile|desktop|sticky|fixed|form|toggle|panel|group|col|column|title|posts?|entry|article|articles|"
    r"stories|google|dfp|js|id|users?|readers?|visitors?|guests?|blog|wp|fb|facebook|threads?|law|info|legal|in|mid|mpu|leaderboard|cta|email|kit|"
    r"\d+(?:x\d+)?|"
)
# What others say or sell: never a section of the article, whatever its heading.
FOREIGN = re.compile(r"ads?|adv|adsense|adbox|cookies?|gdpr|comments?|commentlist|disqus|reply|replies|respond|newsletter|signup|popup|outbrain|taboola")
HALVES = re.compile(
    r"(?<![^-_])(?:(pop|sign|side|skip)[-_](up|bar|link)|(most)[-_](popular|read)|(latest)[-_](news)|(site)[-_](info)|(author)[-_](bio)|(trending)[-_](now))(?![^-_])"
)
# One such part is enough beside any other, but for those that say what a page has, lacks or allows.
UNMISTAKABLE = re.compile(r"advert\w*|adsense|comments|commentlist|disqus|cookies?|newsletter|promos?|signup|outbrain|taboola|sponsored")
MODIFIERS = frozenset("has have no non not with without is are show shown hide hidden open opened closed enabled disabled allow allowed free before after".split())
CUT_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@lru_cache(1 << 16)
def clutter(token: str) -> tuple[tuple[str, ...], bool]:
    """The parts of a class token or id that name clutter, and whether no part says something else.

    If one does, as in has-sidebar or notice-period, only unmistakable parts count, and none beside a modifier.
    """
    parts = re.split("[-_]+", HALVES.sub(lambda m: "".join(g for g in m.groups() if g), token.lower()))
    named = tuple(p for p in parts if CLUTTER.fullmatch(p))
    if all(p in named or BESIDE.fullmatch(p) for p in parts):
        return named, True
    return (() if MODIFIERS.intersection(parts) else tuple(p for p in parts if UNMISTAKABLE.fullmatch(p))), False


class Node:
    __slots__ = ("children", "cut", "doubt", "heading", "link_text", "name", "paragraph", "paragraphs", "parent", "points", "text")

    def __init__(self, name: str, parent: Node | None, cut: bool) -> None:
        self.name, self.parent, self.cut = name, parent, cut
        self.children: list[Node | str] = []
        self.points, self.text, self.link_text = 0.0, 0, 0
        # Characters of paragraphs below it, and the place of its first heading among all blocks.
        self.paragraphs, self.heading = 0, -1
        # The open paragraph that a block here would end.
        self.paragraph: Node | None = self if name == "p" else None if parent is None or name in WALLS else parent.paragraph
        # Names of clutter in its class tokens and its id, each with the token; settled once the whole tree is known.
        self.doubt: list[tuple[str, tuple[str, ...], bool]] = []


class Tree(HTMLParser):
    """Builds the tree; bad nesting is mended as browsers do for common cases."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None, False)
        self.at = self.root
        self.doubtful = False
        # How many elements of each name are open.
        self.open: Counter[str] = Counter()

    def _end(self, last: Node) -> None:
        while self.at is not last:
            self.open[self.at.name] -= 1
            self.at = self.at.parent
        self.open[last.name] -= 1
        self.at = last.parent

    def _close(self, names: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        if not any(self.open[name] for name in names):
            return
        node = self.at
        while node.parent is not None and node.name not in walls:
            if node.name in names:
                self._end(node)
                return
            node = node.parent

    def _is_cut(self, name: str, attrs: dict[str, str | None]) -> bool:
        if name in ("html", "body", "main", "article"):
            return False
        if name in CUT or (attrs.get("role") or "").lower() in CUT_ROLE:
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style") or ""):
            return True
        return name == "header" and not (self.open["article"] or self.open["main"])

    def _doubt(self, name: str, attrs: dict[str, str | None]) -> list[tuple[str, tuple[str, ...], bool]]:
        if name in ("html", "body", "header") or name in HEADINGS:
            return []
        tokens = [*(attrs.get("class") or "").split(), (attrs.get("id") or "").strip()]
        return [(t, *found) for t in tokens if t and (found := clutter(t))[0]]

    def handle_starttag(self, name: str, attributes: list[tuple[str, str | None]]) -> None:
        if name in ENDS:
            self._close(*ENDS[name])
        if name in BLOCKS:
            if self.at.paragraph is not None:
                self._end(self.at.paragraph)
            if name in HEADINGS:
                self._close(HEADINGS, WALLS | {"div", "li"})
        attrs = dict(attributes)
        node = Node(name, self.at, self.at.cut or self._is_cut(name, attrs))
        if not node.cut and (doubt := self._doubt(name, attrs)):
            node.doubt = doubt
            self.doubtful = True
        self.at.children.append(node)
        if name not in VOID:
            self.open[name] += 1
            self.at = node

    def handle_startendtag(self, name: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(name, attributes)

    def handle_endtag(self, name: str) -> None:
        if name == "br":
            self.at.children.append(Node("br", self.at, self.at.cut))
            return
        self._close({name}, WALLS - {name} if name in BLOCKS and name not in ("p", "li") else WALLS)

    def handle_data(self, data: str) -> None:
        if not self.at.cut:
            self.at.children.append(data)


def _nodes(root: Node) -> Iterator[Node]:
    """All nodes that are not cut, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.cut)


def blocks_of(root: Node) -> list[tuple[Node, str]]:
    """Blocks of text below ``root`` in page order, white space turned into single spaces, each with its element."""
    found: list[tuple[Node, str]] = []
    parts: list[str] = []
    owner = root

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append((owner, text))

    stack: list[tuple[str, Node | str]] = [("open", root)]
    while stack:
        kind, item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif kind == "close":
            flush()
            owner = item.parent or root
        elif not item.cut:
            if item.name in BLOCKS or item is root:
                flush()
                owner = item
                stack.append(("close", item))
            elif item.name == "br":
                parts.append(" ")
            stack.extend(("open", c) for c in reversed(item.children))
    flush()
    return found


def _measure(root: Node) -> None:
    """Characters of text and of link text below every node."""
    for node in reversed(list(_nodes(root))):
        node.text += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.name == "a":
            node.link_text = node.text
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.link_text += node.link_text


def _slug(text: str) -> str:
    return "-".join(re.findall(r"\w+", text.lower().replace("_", "-")))


def _above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def _settle(root: Node) -> None:
    """Cut what is named as clutter, except what holds the article, is a section of it, or is most of the page.

    Sums for all nodes are made in one pass, so boxes in boxes take no longer than boxes side by side.
    """
    _measure(root)
    blocks = blocks_of(root)
    for place, (owner, text) in enumerate(blocks):
        if owner.name not in HEADINGS:
            owner.paragraphs += len(text)
        elif owner.heading < 0:
            owner.heading = place
    for node in reversed(list(_nodes(root))):
        above = node.parent
        if above is not None:
            above.paragraphs += node.paragraphs
            if node.heading >= 0 and (above.heading < 0 or node.heading < above.heading):
                above.heading = node.heading
    bodies = [n for n in _nodes(root) if n.name in ("article", "main")]
    body = max(bodies, key=lambda n: n.text - n.link_text, default=None)
    holders = {id(n) for n in (body, *_above(body))} if body is not None else set()
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.doubt and id(node) not in holders:
            node.cut = _unwanted(node, inside, bodies, body if body is not None else root, blocks)
        if not node.cut:
            inside = inside or node.name in ("article", "main")
            stack.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node) and not c.cut)
    for node in _nodes(root):
        node.text = node.link_text = 0


def _unwanted(node: Node, inside: bool, bodies: list[Node], body: Node, blocks: list[tuple[Node, str]]) -> bool:
    """Whether a node named as clutter is such; ``inside`` an article or not."""
    doubt = [d for d in node.doubt if not (inside and set(d[1]) <= {"header", "masthead", "banner"})]
    if not doubt or any(sure and FOREIGN.fullmatch(n) for _, named, sure in doubt for n in named):
        return bool(doubt)
    # Text of inline elements is no block of their own.
    paragraphs = node.paragraphs if node.name in BLOCKS else node.text
    if node.link_text > 0.25 * paragraphs:
        paragraphs = 0
    heading = blocks[node.heading][1] if node.heading >= 0 else ""
    if (inside or not bodies) and paragraphs and all(_slug(heading) == _slug(t) or (node.name == "section" and heading and sure) for t, _, sure in doubt):
        return False
    most = paragraphs >= 200 and 2 * (node.text - node.link_text) > body.text - body.link_text
    return not (most and (not bodies or (inside and not any(sure for _, _, sure in doubt))))


def _reads(node: Node) -> bool:
    """Whether there is a paragraph below ``node``: a long one, or a sentence."""
    return any(
        owner.name in ("p", "pre", "blockquote", "li", "dd") and (len(text) >= 80 or text.rstrip("\"')]”’»").endswith((".", "!", "?", "…", "。", "！", "？")))
        for owner, text in blocks_of(node)
    )


def _links(node: Node) -> float:
    return min(1.0, node.link_text / node.text) if node.text else 0.0


def main_text(html: str | None) -> str:
    """Article text of a page; empty if there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    if tree.doubtful:
        _settle(tree.root)
    _measure(tree.root)
    scored: dict[int, Node] = {}
    for owner, text in blocks_of(tree.root):
        if owner.name in HEADINGS:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        # A container's own loose text speaks for the container itself.
        level, node = (0, owner) if owner.name not in ("p", "pre", "li", "td", "dd", "blockquote", "figcaption") else (0, owner.parent)
        while node is not None and level < 6:
            node.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            scored[id(node)] = node
            level, node = level + 1, node.parent
    if not scored:
        only = [text for _, text in blocks_of(tree.root)]
        return "\n".join(only)
    best = max(scored.values(), key=lambda n: n.points * (1 - _links(n)))
    # A part of an article stands for the article.
    node = best
    while node is not None:
        if node.name in ("article", "main"):
            best = node
        node = node.parent
    # An article among loose text is the article.
    if best.name not in ("article", "main"):
        for name in ("article", "main"):
            inside = [n for n in _nodes(best) if n.name == name and n.text > n.link_text]
            if inside:
                best = max(inside, key=lambda n: n.text - n.link_text)
                break
    top, keep = best.points * (1 - _links(best)), []
    for sibling in best.parent.children if best.parent is not None else [best]:
        if sibling is best or isinstance(sibling, str):
            keep.append(sibling)
        elif not sibling.cut and _links(sibling) < 0.25 and (
            sibling.points * (1 - _links(sibling)) >= 0.2 * top or _reads(sibling)
            or sibling.name in HEADINGS or sibling.name in ("p", "pre", "blockquote", "ul", "ol", "table", "figure")
            or (sibling.name not in BLOCKS and best.name not in ("article", "main"))
        ):
            keep.append(sibling)
    if best.name in ("article", "main", "body", "html", "#root"):
        keep = [k for k in keep if k is best or (isinstance(k, Node) and k.name == best.name)]
    top_node = Node("#kept", None, False)
    top_node.children = keep
    return "\n".join(text for _, text in blocks_of(top_node))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, empty if there is none) and n_chars (its code points) per row of ``pages``.

    A null page is an empty one.  Rows are independent of each other, so repeated rows
    give repeated results and an empty table an empty one; further columns are not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
