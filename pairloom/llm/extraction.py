"""Main text of HTML pages by tree scoring.

A page becomes a tree of block elements; inline elements only mark where links are. Elements that never hold an
article (scripts, forms, menus, page headers and footers, asides) and those whose class, id or role names an advert,
menu, notice or comment list are left out with all they hold, unless the page's only article is in there. Whole words of a class
count, and none beside a state: ``has-sidebar`` and ``comments-open`` name what is around an article. Every text block passes points to its ancestors: one,
one per comma, and one per 100 characters (at most ``LENGTH_POINTS``), all of it to the parent, half to the grandparent, a third and
less above. Points are discounted by the share of link text. The best container is kept, or the article (else main) element around it, with those siblings that
score a fifth of it or are long blocks of few links. Blocks of the kept elements are joined by a line break in page
order; white space inside a block becomes one space.

Unclosed and wrongly nested tags are closed by the usual rules. Null or empty html gives ''. A page without scored
blocks gives all its remaining blocks. Repeated pages are extracted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH_POINTS = 3.0

# Element names of HTML and words that name parts outside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select noembed noframes xmp".split())
DROPPED = frozenset("head nav footer aside form button fieldset dialog menu video audio map datalist label legend optgroup option applet".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup "
    "html li main ol p pre section summary table tbody tfoot thead tr ul caption search".split()
) | DROPPED
CLOSES_P = BLOCKS - {"caption", "tbody", "thead", "tfoot", "tr"}
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "tbody": {"tr", "tbody", "thead"}, "tfoot": {"tr", "tbody", "thead"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
# Parts of a class or id that name what is not the article; those after the first list never hold it by their size.
PLACES = "header masthead modal overlay popup share sharing sidebar sidebars skip social toolbar topbar widget"
NOTICES = (
    "ad ads advert advertisement adverts adsense adbox alert banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr "
    "menu menus nav navbar navigation newsletter notice notices notification outbrain pagination pager promo promoted promotion recommend "
    "recommended recommendations related rss sponsor sponsored sponsors subscribe subscription taboola"
)
COMMENTS = "comment comments commentlist discussion disqus replies reply respond"
PLACE, NOTICE, COMMENT, SURE = 1, 2, 3, 4
DOUBTS = dict.fromkeys(PLACES.split(), PLACE) | dict.fromkeys(NOTICES.split(), NOTICE) | dict.fromkeys(COMMENTS.split(), COMMENT)
# Beside one of them these say how a container looks or what it has around it, as in has-sidebar or comments-open.
STATES = frozenset("active closed disabled enabled expanded collapsed fixed has hide hides layout no not off on open opened show shows visible with without".split())
LONG_BLOCK, LONG_TEXT = 80, 400
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WATCHED = re.compile(r"class|id\b|role|hidden|style|itemprop", re.I)


class Node:
    __slots__ = ("name", "parent", "children", "skip", "score", "text", "links", "main", "heads_only", "doubt", "long", "all", "linked", "holds")

    def __init__(self, name, parent, skip=False, main=False):
        self.name, self.parent, self.skip, self.main = name, parent, skip, main
        self.children = []  # nodes and finished text blocks (str, link characters)
        self.score = 0.0
        self.text = self.links = 0
        self.heads_only = False
        self.doubt = self.long = self.all = self.linked = 0
        self.holds = False


def doubt_of(names: str) -> int:
    """The strongest doubt that a class or id raises, 0 if none."""
    found = 0
    for token in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", token) if p]
        if not STATES.intersection(parts):
            found = max([found, *(DOUBTS.get(p, 0) for p in parts)])
    return found


def _unlikely(name: str, raw: str) -> tuple[int, bool]:
    """(doubt, whether marked as the main text) from an element's attributes."""
    if not WATCHED.search(raw):
        return 0, False
    values = {}
    for m in ATTRIBUTE.finditer(raw):
        values.setdefault((m[1] or m[5]).lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    role = values.get("role", "").lower()
    main = role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody"
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or HIDDEN.search(values.get("style", "")):
        return SURE, False
    names = f"{values.get('class', '')} {values.get('id', '')}"
    if main or name in ("article", "main", "body", "html"):
        comment = name == "article" and doubt_of(names) == COMMENT
        return (COMMENT if comment else 0), main and not comment
    return (SURE if role in ROLES else doubt_of(names)), False


def parse(page: str) -> Node:
    root = node = Node("html", None)
    buffer: list[str] = []
    linked = in_link = 0
    skip = 0

    def flush():
        nonlocal linked
        if buffer:
            block = " ".join("".join(buffer).split())
            if block:
                node.children.append((block, min(linked, len(block))))
            buffer.clear()
        linked = 0

    def close(to):
        nonlocal node, skip, in_link
        flush()
        while node is not to:
            skip -= node.skip
            node = node.parent
        in_link = 0

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at and not skip:
            piece = page[at:stop]
            if "&" in piece:
                piece = entities.unescape(piece)
            buffer.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else (at if name in ("title", "object", "svg", "math", "canvas") else size)
            continue
        if name not in BLOCKS:
            if name == "br" or name in ("td", "th", "hr"):
                if not skip:
                    buffer.append(" ")
                if name == "hr":
                    flush()
            elif name == "a":
                in_link = 0 if closing else 1
            elif not closing and name not in VOID and not skip and WATCHED.search(m[3]) and _unlikely(name, m[3])[0]:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)  # a left-out inline element
                inner = re.compile(rf"<{re.escape(name)}\b", re.I).search(page, at, end.start()) if end else None
                if end and not inner:
                    at = end.end()
            continue
        if closing:
            if name in ("html", "body"):
                continue
            found = node
            while found is not None and found.name != name:
                found = found.parent
            if found is not None and found.parent is not None:
                close(found.parent)
            elif name == "p":
                flush()
            continue
        if name in ("html", "body"):
            flush()
            continue
        if node.name == "head" or (skip and name not in DROPPED and _inside(node, "head")):
            close(_inside(node, "head").parent)
        if name in CLOSES_P:
            if node.name == "p":
                close(node.parent)
            elif node.name[0] == "h" and node.name[1:].isdigit() and name[0] == "h" and name[1:].isdigit():
                close(node.parent)
        if name in OWN_KIND:
            up = node
            while up.parent is not None and up.name not in OWN_KIND[name] and up.name not in HOLDERS[name]:
                up = up.parent
            if up.name in OWN_KIND[name] and up.parent is not None:
                close(up.parent)
        flush()
        doubt, main = _unlikely(name, m[3])
        left_out = doubt == SURE
        child = Node(name, node, False, main)
        child.doubt = doubt
        if name == "header" and not left_out and _article(node):
            child.heads_only = True
        elif name in DROPPED or name == "header" or left_out:
            child.skip = True
        if node.heads_only or (node.parent is not None and node.parent.heads_only):
            child.skip = child.skip or not (name == "hgroup" or (name[0] == "h" and name[1:].isdigit()))
        node.children.append(child)
        if m[0].endswith("/>") and name not in ("p", "div", "li"):
            continue
        node = child
        in_link = 0
        skip += child.skip
    flush()
    return root


def _inside(node, name):
    while node is not None and node.name != name:
        node = node.parent
    return node


def _article(node):
    while node is not None:
        if node.name in ("article", "main") or node.main:
            return node
        node = node.parent
    return None


def settle(root: Node) -> None:
    """Leave out the doubtful elements, save those around the article.

    Where no article or main element stands outside them, one that holds such an element stays (a comment list only if
    there is no long block outside either). A place (sidebar, header, widget and the like) also stays if its long blocks
    of few links outweigh those outside doubtful elements three times: the page's text is there.
    """
    nodes = list(walk(root))
    if not any(n.doubt for n in nodes):
        return
    outside, article = 0, False
    under: dict[int, bool] = {}
    for node in nodes:
        under[id(node)] = bool(node.doubt) or (node.parent is not None and under.get(id(node.parent), False))
        article |= not under[id(node)] and (node.main or node.name in ("article", "main"))
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, Node):
                if not c.skip:
                    node.all, node.linked, node.long = node.all + c.all, node.linked + c.linked, node.long + c.long
                    node.holds |= not c.doubt and (c.holds or c.main or c.name in ("article", "main"))
            else:
                node.all, node.linked = node.all + len(c[0]), node.linked + c[1]
                if len(c[0]) >= LONG_BLOCK and c[1] * 4 < len(c[0]):
                    node.long += len(c[0])
                    outside += 0 if under[id(node)] else len(c[0])
    stack = [root]
    while stack:
        node = stack.pop()
        held = node.holds and not article and (node.doubt < COMMENT or not outside)
        heavy = node.doubt == PLACE and node.long >= LONG_TEXT and node.long >= 3 * outside and node.linked * 3 < node.all
        if node.doubt and not held and not heavy:
            node.skip = True
        else:
            stack.extend(c for c in node.children if isinstance(c, Node) and not c.skip)


def walk(root: Node):
    """Nodes in page order, parents first, without those left out."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.skip)


def score(root: Node) -> None:
    nodes = list(walk(root))
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, Node):
                if not c.skip:
                    node.text += c.text
                    node.links += c.links
            elif not node.heads_only:
                node.text += len(c[0])
                node.links += c[1]
    for node in nodes:
        for c in node.children:
            if isinstance(c, Node) or len(c[0]) < 25:
                continue
            points = 1 + c[0].count(",") + min(len(c[0]) / 100, LENGTH_POINTS)
            points *= 1 - c[1] / len(c[0])
            own = node.name in ("p", "pre", "li", "dd", "dt", "blockquote", "tr") or (node.name[0] == "h" and node.name[1:].isdigit())
            up, level = (node.parent if own and node.parent else node), 1
            while up is not None:
                up.score += points / level
                up, level = up.parent, level + 1
    for node in nodes:
        if node.text:
            node.score *= 1 - node.links / node.text


def blocks_of(node: Node) -> list[str]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if not x.skip:
                stack.extend(c for c in reversed(x.children) if isinstance(c, Node) or not x.heads_only)
        else:
            out.append(x[0])
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    score(root)
    nodes = list(walk(root))
    best = max(nodes, key=lambda n: n.score)
    if best.score <= 0:
        return "\n".join(blocks_of(root))
    up, main = best, None
    while up is not None:
        if up.name == "article" or (up.main and main is None):
            main = up
            break
        if up.name == "main":
            main = main or up
        up = up.parent
    best = main or best
    if best.parent is None:
        return "\n".join(blocks_of(best))
    if main is not None and best.name != "article":
        return "\n".join(blocks_of(best))
    out: list[str] = []
    for c in best.parent.children:
        if c is best:
            out += blocks_of(c)
        elif isinstance(c, Node):
            if c.skip:
                continue
            few_links = c.links * 4 < c.text
            if c.score >= 0.2 * best.score and few_links or c.name in ("p", "pre", "blockquote") and few_links and c.text >= 80:
                out += blocks_of(c)
            elif main is None and c.name[0] == "h" and c.name[1:].isdigit() and few_links:
                out += blocks_of(c)
        elif c[1] * 4 < len(c[0]) and len(c[0]) >= 80:
            out.append(c[0])
    return "\n".join(out)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns but ``html``, and the main text as ``out``."""
    keep = [c for c in pages.columns if c not in (html, out)]
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html).alias("__html"))

    def work(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, out])

    return source.mapInArrow(work, T.StructType([*source.schema.fields[:-1], T.StructField(out, T.StringType())]))
