"""HTML extraction: composite text density. Every node of the DOM gets its characters per tag, adjusted for
links; the densities of a node's children are summed, the container with the largest sum is the best, and the
smallest density on its path from the body is the threshold for what else is text.

Nodes that say what they are (menus, page headers, footers, sidebars, notices, adverts, forms, comments, by
element or by a class or id of no other words) and what is never shown go before densities are computed, but for
those that hold the page's article (`free_wrappers`). A class that only has such a word among others
("related-work", "social-history"), or stands at a paragraph, proves nothing: the densities decide (`judge`). Where
a page without main and article elements has no other text, the box with most text is the article, whatever its
class. The text's region is the main or article element around the best
container (with the articles beside it that are labelled alike), else the lowest node around it that leaves
no section, heading, paragraph or bare text beside it. Of an article all goes out that is not aside; of
another region a block goes if it is mostly links and less dense than the threshold; outside, a block is
kept only if it is at least as dense and has few links.

One page is one row of a map without shuffle; work and memory follow the page's length.

Defined results: null and empty html, and pages without text, give an empty text; unclosed and crossing
tags close as browsers close them, cut-off tags are dropped; repeated rows give equal texts; extra columns
pass through unread.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import common as C

# Elements by what they do in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title textarea select option svg iframe object canvas audio video".split())
CHROME = frozenset("nav footer aside form button dialog menu".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
CONTAINERS = frozenset("body article section div main td table tbody ul ol dl details figure fieldset center header".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("body article section div table td th ul ol dl main nav footer aside header blockquote form".split())
# Words in class or id that name what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu header masthead footer sidebar aside widget "
    "notice cookie cookies consent gdpr popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus reply replies "
    "breadcrumb breadcrumbs pagination pager login search skip toolbar copyright".split()
)
# Words that say where or how a box stands.
PLACES = frozenset("area bar block bottom box container form inner left list main right section slot top unit wrap wrapper".split())
# Words that with a word of the first list still name what is not the article.
UNITS = frozenset("site page posts stories links buttons icons content row column primary secondary".split())
# Words that mean other people's or paid text in any company.
VOICES = frozenset("ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies".split())
# Those of the words that themes also give to wrappers of the whole page ("with-sidebar", "fixed-header").
LAYOUT_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar aside banner widget share sharing social search toolbar".split())
# Elements that are the page's text or a part of it, and those beside which a container is only a part.
TEXTS = frozenset(("article", "main"))
PARTS = frozenset("ul ol dl table tbody details figure fieldset center header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
# The rest of a tag after its name, up to its end: a quote opens a value only after "=", and "<" outside a quoted
# value ends the attempt, so that pages of unclosed tags are read in linear time.
_REST = r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>]*+))*+>"
_DROP = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b{_REST}.*?(?:</\1\s*>|\Z)|<[!?][^<>]*+>", re.S | re.I)
_TAG = re.compile(rf"(</?[a-zA-Z]{_REST})")
_CUT = re.compile(r"</?[a-zA-Z][^<>]*\Z")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_LABEL = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "links", "link_tags", "aside", "doubt", "density", "label")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False, label: tuple[str, ...] = (), doubt: bool = False):
        self.tag, self.parent, self.aside, self.label, self.doubt = tag, parent, aside, label, doubt
        self.children: list[Node] = []
        self.parts: list[Node | str] = []
        if parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


def labels(tag: str, inside_article: bool) -> tuple[tuple[str, ...], bool]:
    """The words in class, id and role of a tag, and whether one of the names there has no word but those of what is
    not the article. Inside an article an id counts only if nothing in it names a topic, since ids there are often
    made from headings."""
    out: list[str] = []
    named = False
    for found in _LABEL.finditer(tag) if "=" in tag else ():
        words = [w for w in re.split(r"[\s_\-]+", (found[2] or found[3] or found[4] or "").lower()) if w]
        if not inside_article or found[1].lower() != "id" or all(w in ASIDE_WORDS or w in PLACES or w.isdigit() for w in words):
            out += words
            for name in (found[2] or found[3] or found[4] or "").lower().split():
                parts = [w for w in re.split(r"[_\-]+", name) if w]
                sure = any(w in VOICES for w in parts) or all(w in ASIDE_WORDS or w in PLACES or w in UNITS or w.isdigit() for w in parts)
                named = named or (sure and any(w in ASIDE_WORDS for w in parts))
    return tuple(out), named


def by_element(name: str, inside_article: bool) -> bool:
    return name in HIDDEN or name in CHROME or (name == "header" and not inside_article)


def is_aside(name: str, label: tuple[str, ...], inside_article: bool) -> bool:
    if by_element(name, inside_article):
        return True
    if name in ("article", "main", "body", "html") or (inside_article and name in HEADINGS):
        return False
    return any(w in ASIDE_WORDS for w in label)


def parse(page: str) -> Node:
    """The page's tree of shown elements and texts."""
    root = Node("body", None)
    stack = [root]
    articles, opened = 0, Counter()

    def close(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            opened[stack[-1].tag] -= 1
            articles -= stack.pop().tag in ("article", "main")

    for i, piece in enumerate(_TAG.split(_CUT.sub("", _DROP.sub("", page)))):
        if not i % 2:
            if piece:
                stack[-1].parts.append(entities.unescape(piece) if "&" in piece else piece)
            continue
        name = _NAME.match(piece)[1].lower()
        if piece[1] == "/":
            at = len(stack) - 1 if opened[name] else 0
            while at > 0 and stack[at].tag != name:
                if name not in SCOPE and stack[at].tag in SCOPE:
                    at = 0
                at -= 1
            if at > 0:
                close(at)
            continue
        if name in ("html", "body"):
            continue
        closed = CLOSED_BY.get(name, {"p"} if name in CLOSES_P else ())
        if closed:
            at = len(stack) - 1
            while at > 0 and stack[at].tag not in closed and stack[at].tag not in SCOPE:
                at -= 1
            if at > 0 and stack[at].tag in closed:
                close(at)
        label, named = labels(piece, articles > 0)
        aside = is_aside(name, label, articles > 0)
        node = Node(name, stack[-1], aside, label, aside and not by_element(name, articles > 0) and (not named or name in FLOW))
        if name not in VOID and not piece.endswith("/>"):
            stack.append(node)
            opened[name] += 1
            articles += name in ("article", "main")
    free_wrappers(root)
    judge(root)
    return root


def free_wrappers(root: Node) -> None:
    """Takes the aside mark from nodes that hold the page's text: around a main element always, around an article
    that has as much text as all that is not aside, and for a form or a name of `LAYOUT_WORDS` alone if the node itself
    has as much."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag not in HIDDEN:
            nodes.append(node)
            todo.extend(node.children)
    if not any(n.aside for n in nodes):
        return
    def is_wrapper(node: Node) -> bool:
        if node.tag != "form" and (node.tag in CHROME or node.tag == "header"):
            return False
        return all(w in LAYOUT_WORDS for w in node.label if w in ASIDE_WORDS)

    shown: dict[int, int] = {}
    held: dict[int, int] = {}
    most: dict[int, int] = {}
    has_main: set[int] = set()
    for node in reversed(nodes):
        below = [c for c in node.children if c.tag not in HIDDEN]
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        shown[id(node)] = 0 if node.tag == "a" else own + sum(shown[id(c)] for c in below if not c.aside)
        held[id(node)] = 0 if node.tag == "a" else own + sum(held[id(c)] for c in below if not c.aside or is_wrapper(c))
        most[id(node)] = max([shown[id(node)] if node.tag == "article" else 0, *(most[id(c)] for c in below)])
        if node.tag == "main" or any(id(c) in has_main for c in below):
            has_main.add(id(node))
    inside = [(root, max(1, shown[id(root)]))]
    while inside:
        node, rest = inside.pop()
        if node.aside:
            if id(node) not in has_main and most[id(node)] < rest and not (is_wrapper(node) and not has_main and held[id(node)] >= rest):
                continue
            node.aside, rest = False, rest + shown[id(node)]
        inside.extend((c, rest) for c in node.children if c.tag not in HIDDEN)


def in_order(root: Node) -> list[Node]:
    """All nodes that are not aside, parents first."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.aside:
            found.append(node)
            todo.extend(reversed(node.children))
    return found


def measure(nodes: list[Node]) -> None:
    """Counts, and then the composite density of every node."""
    for node in reversed(nodes):
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        below = [c for c in node.children if not c.aside]
        node.chars = own + sum(c.chars for c in below)
        node.tags = sum(c.tags + 1 for c in below)
        is_link = node.tag == "a"
        node.links = node.chars if is_link else sum(c.links for c in below)
        node.link_tags = is_link + sum(c.link_tags for c in below)
    body = nodes[0]
    share = body.links / max(1, body.chars)
    for node in nodes:
        chars, tags, links = node.chars, max(1, node.tags), max(1, node.links)
        base = math.log(chars / max(1, chars - node.links) * node.links + share * chars + math.e)
        node.density = chars / tags * math.log(max(1.0, chars / links * tags / max(1, node.link_tags)) + 1e-9 + (chars > 0)) / math.log(base + 1) if chars else 0.0


def best_container(nodes: list[Node]) -> tuple[Node, float]:
    """The container with the largest sum of its children's densities, and the smallest density from there up."""
    sums = [sum(c.density for c in n.children if not c.aside) for n in nodes]
    best = nodes[max((i for i, n in enumerate(nodes) if n.tag in CONTAINERS), key=lambda i: (sums[i], -i))]
    least, up = best.density, best.parent
    while up is not None:
        least, up = min(least, up.density), up.parent
    return best, least


def blocks_of_text(nodes: list[Node]) -> list[int]:
    """The lengths of the texts that stand together in a block element, headings and links left out; nodes come
    parents first."""
    lengths: dict[int, int] = {}
    holder: dict[int, Node | None] = {}
    for node in nodes:
        above = holder.get(id(node.parent), node)
        up = holder[id(node)] = None if above is None or node.tag == "a" or node.tag in HEADINGS else node if node.tag in BLOCK else above
        if up is not None:
            lengths[id(up)] = lengths.get(id(up), 0) + sum(len(p.strip()) for p in node.parts if isinstance(p, str))
    return [n for n in lengths.values() if n]


def judge(root: Node) -> None:
    """Decides on the nodes that only a word of their class or id speaks against. Of those in doubt a node stays if it
    is not mostly links, at least as dense as the path from the body to the best container, and at least half as long
    as a block of text on the page is on average; one in an article whose name has other words too needs only not to be
    mostly links. If then a page without main and article has left less than a quarter of an average block, the named node
    with the most text is its article."""
    nodes, todo = [], [(root, False)]
    doubts: list[tuple[Node, bool]] = []
    named: list[Node] = []
    has_article = False
    while todo:
        node, inside = todo.pop()
        if node.aside and by_element(node.tag, inside):
            continue
        nodes.append(node)
        inside = inside or node.tag in TEXTS
        has_article = has_article or inside
        if node.aside and node.doubt:
            doubts.append((node, inside))
        elif node.aside:
            named.append(node)
            continue
        todo.extend((c, inside) for c in reversed(node.children))
    if not doubts and not named:
        return
    boxes: list[list[Node]] = []
    for node in named:
        boxes.append([])
        todo = [node]
        while todo:
            one = todo.pop()
            boxes[-1].append(one)
            todo.extend(c for c in reversed(one.children) if not by_element(c.tag, False))
    boxed = [blocks_of_text(box) for box in boxes]
    lengths = blocks_of_text([n for n in nodes if not n.aside or n.doubt])
    half = sum(lengths) / max(1, len(lengths)) / 2
    if doubts:
        for node, _ in doubts:
            node.aside = False
        shown = in_order(root)
        measure(shown)
        _, least = best_container(shown)
        for node, inside in doubts:
            linky = node.chars == 0 or 2 * node.links > node.chars
            free = inside and node.tag not in FLOW
            node.aside = linky or not free and (node.chars < half or node.density < least)
    if not named or has_article:
        return
    rest, total = blocks_of_text(in_order(root)), [n for one in boxed for n in one] + lengths
    most = max(range(len(boxes)), key=lambda i: sum(boxed[i]))
    if boxed[most] and 4 * sum(rest) * len(total) < sum(total):
        for node in boxes[most]:
            node.aside = False


def has_text(node: Node) -> bool:
    return not node.aside and node.chars > 0 and 2 * node.links <= node.chars


def regions(best: Node) -> list[Node]:
    """The nodes whose text is the page's, by the container with the largest sum of densities."""
    around, up = [], best
    while up is not None:
        around.append(up)
        up = up.parent
    for tag in ("main", "article"):
        if found := [n for n in around if n.tag == tag]:
            node = found[-1]
            beside = node.parent.children if tag == "article" else [node]
            return [n for n in beside if n is node or (n.tag == tag and n.label == node.label and has_text(n))]
    node = best
    while node.parent is not None:
        others = [n for n in node.parent.children if n is not node and has_text(n)]
        flows = any(n.tag in FLOW for n in others) or any(isinstance(p, str) and p.strip() for p in node.parent.parts)
        alike = any(n.tag == node.tag and (n.tag == "section" or n.label == node.label) for n in others)
        if not (flows or alike or node.tag in PARTS):
            break
        node = node.parent
    return [node]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = in_order(root)
    measure(nodes)
    best, threshold = best_container(nodes)
    wanted = regions(best)
    kept, onward = {id(n) for n in wanted}, set()
    for node in wanted:
        up = node.parent
        while up is not None:
            onward.add(id(up))
            up = up.parent
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    whole = TEXTS if up is None else frozenset(("article",))
    out: list[str] = []
    todo: list[tuple[Node | str, bool, bool]] = [(root, id(root) in kept, False)]
    while todo:
        part, inside, free = todo.pop()
        if isinstance(part, str):
            if inside:
                out.append(part)
            continue
        if part.aside:
            out.append(" " if part.tag in BLOCK else "")
            continue
        linky = 2 * part.links > part.chars
        if inside and not free and part.tag in BLOCK and linky and part.density < threshold:
            out.append(" ")
            continue
        within = inside or id(part) in kept or (id(part) not in onward and part.tag in BLOCK and not linky and part.chars > 0 and part.density >= threshold)
        free = free or (within and part.tag in whole)
        around = " " if part.tag in BLOCK else ""
        todo.append((around, True, free))
        todo.extend((p, within, free) for p in reversed(part.parts))
        out.append(around)
    return " ".join("".join(out).split())


def extract_text(pages: DataFrame, *, html_col: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text added (in place of a column of that name)."""
    kept = [c for c in pages.columns if c != to]
    named = pages.select(*[pages[c].alias(f"c_{i}") for i, c in enumerate(kept)], pages[html_col].cast("string").alias("_html"))

    def run(batches):
        for batch in batches:
            for part in C.slices([batch], "_html"):
                texts = pa.array([main_text(p.as_py()) for p in part.column("_html")], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*part.schema.names[:-1], "_text"])

    schema = named.schema
    done = named.mapInArrow(run, T.StructType([*schema.fields[:-1], T.StructField("_text", T.StringType())]))
    return done.select(*[done[f"c_{i}"].alias(c) for i, c in enumerate(kept)], done["_text"].alias(to))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    texts = extract_text(C.table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
