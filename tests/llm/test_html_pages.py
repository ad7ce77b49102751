"""Main text of pages unlike the one template of the test data."""

import pytest

from lectern.llm import html_text

LONG = ["Longer prose " + " ".join(f"{t}{i}" for i in range(80)) + "." for t in "abcdef"]
SECTIONS = f"<section><h2>One</h2><p>{LONG[0]}<p>{LONG[1]}<p>{LONG[2]}</section><section><h2>Two</h2><p>{LONG[3]}<p>{LONG[4]}<p>{LONG[5]}</section><section><p>Short end.</section>"
TEXT = f"One {LONG[0]} {LONG[1]} {LONG[2]} Two {LONG[3]} {LONG[4]} {LONG[5]} Short end."
NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
FOOT = "<footer>Copyright</footer>"


@pytest.mark.parametrize(
    "page, text",
    {
        "sections": (f"<body>{NAV}<article><h1>A title of thirty characters!</h1>{SECTIONS}</article>{FOOT}", f"A title of thirty characters! {TEXT}"),
        "sections without article": (f"<body>{NAV}<div id=content><h1>Title</h1>{SECTIONS}</div>{FOOT}", f"Title {TEXT}"),
        "divs labelled alike": (f"<body><div id=content><div class=part><p>{LONG[0]}</div><div class=part><p>Brief.</div></div><div class=top>Site</div>{FOOT}", f"{LONG[0]} Brief."),
        "bare text in article": (f"<article>Bare start <section><p>{LONG[0]}<p>{LONG[1]}</section> bare end</article>{FOOT}", f"Bare start {LONG[0]} {LONG[1]} bare end"),
        "bare text in body": (f"<body>{NAV}Bare start <div><p>{LONG[0]}<p>{LONG[1]}</div> bare end{FOOT}", f"Bare start {LONG[0]} {LONG[1]} bare end"),
        "list among paragraphs": (f"<div><p>Before.<ul><li>{LONG[0]}<li>{LONG[1]}</ul><p>After.</div>{FOOT}", f"Before. {LONG[0]} {LONG[1]} After."),
        "links in article": (f"<article><p>{LONG[0]}<p><a href=/s>A source that is only a link</a></article>{FOOT}", f"{LONG[0]} A source that is only a link"),
        "wrapper around article": (f"<body>{NAV}<div class='page with-sidebar'><article><h1>T</h1><p>{LONG[0]}</article><div class=sidebar>Side</div></div>{FOOT}", f"T {LONG[0]}"),
        "wrapper around main": (f"<body><form id=aspnet><div class='has-share header-fixed'><main><h1>T</h1><p>Two words.</main></div></form><div>{FOOT}</div>", "T Two words."),
        "wrapper without article": (f"<body>{NAV}<div class='wrap no-sidebar'><div class=entry><p>{LONG[0]}</div></div>{FOOT}", LONG[0]),
        "articles as comments": (f"<article class=post><p>{LONG[0]}</article><div class=comments><article class=comment><p>Nice!</article></div>", LONG[0]),
        "articles as teasers": (f"<body><aside class=sidebar><article><p>Teaser</article></aside><div class=post><p>{LONG[0]}</div>", LONG[0]),
        "form and sidebar wrappers without article": (f"<body><form action=/x><div class='site has-sidebar'><p>{LONG[0]}<div class=sidebar>Side</div></div></form>{FOOT}", LONG[0]),
        "generated ids, loose quotes, formulas": (f"<article><h2 id=social-effects>Hd</h2><p title=it's>{LONG[0]} <math>x</math></p><section id=search-algorithms><p>Kept.</section></article>", f"Hd {LONG[0]} x Kept."),
        "search form": (f"<body><form><input name=q><label>Find</label></form><div><p>{LONG[0]}<p>{LONG[1]}</div>", f"{LONG[0]} {LONG[1]}"),
        "several articles": (f"<div><article class=post><p>{LONG[0]}</article><article class=post><p>Brief.</article></div>{FOOT}", f"{LONG[0]} Brief."),
        "word in a name around the only paragraph": (f"<body>{NAV}<h1>T</h1><div class=related-work><p>{LONG[0]}</div>{FOOT}", f"T {LONG[0]}"),
        "word in a name within a post": (f"<body>{NAV}<div class=post><p>{LONG[0]}<div class=social-history><p>{LONG[1]}</div><p>{LONG[2]}</div>{FOOT}", f"{LONG[0]} {LONG[1]} {LONG[2]}"),
        "list of a recipe": (f"<body>{NAV}<main><p>{LONG[0]}<ul class=menu-items><li>Two eggs<li>Flour</ul><p>{LONG[1]}</main>{FOOT}", f"{LONG[0]} Two eggs Flour {LONG[1]}"),
        "paragraph with a word": (f"<body>{NAV}<div><p>{LONG[0]}<p class=login>{LONG[1]}</div>{FOOT}", f"{LONG[0]} {LONG[1]}"),
        "short paragraph with a word": (f"<body>{NAV}<div><p>{LONG[0]}<p class=login>Please log in.<p>{LONG[1]}</div>{FOOT}", f"{LONG[0]} {LONG[1]}"),
        "comments longer than the post": (f"<body>{NAV}<div class=post><p>{LONG[0]}</div><div class=user-comments><p>{LONG[1]}<p>{LONG[2]}</div><div class=site-footer>All rights of this site are reserved.</div>{FOOT}", LONG[0]),
        "related links within an article": (f"<article><p>{LONG[0]}<ul class=related-reading><li><a href=/a>One more</a><li><a href=/b>Another</a></ul><p>{LONG[1]}</article>", f"{LONG[0]} {LONG[1]}"),
        "main around article": (f"<main><h1>T</h1><article><p>{LONG[0]}</article></main>{FOOT}", f"T {LONG[0]}"),
    }.values(),
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("word", sorted(html_text.ASIDE_WORDS))
def test_an_article_of_any_class_name_is_kept(word):
    assert html_text.main_text(f"<body>{NAV}<h1>T</h1><div class='{word}'><p>{LONG[0]}<p>{LONG[1]}</div>{FOOT}") == f"T {LONG[0]} {LONG[1]}"


def test_density_against_a_plain_count():
    """Characters, tags, links and densities of every node against counts over its markup by itself."""
    import math
    import random

    rng = random.Random(5)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return "x" * rng.randint(0, 30)
        tag = rng.choice(["div", "p", "a", "span", "ul", "section"]) if depth < 5 else "div"
        return ("tag", tag, [grow(depth - 1) for _ in range(rng.randint(0, 4))])

    def build(part, parent):
        if isinstance(part, str):
            if part:
                parent.parts.append(part)
            return
        node = html_text.Node(part[1], parent)
        for one in part[2]:
            build(one, node)

    def under(node):
        return [c for c in node.children] + [d for c in node.children for d in under(c)]

    def chars(node):
        return sum(len(p) for n in [node, *under(node)] for p in n.parts if isinstance(p, str))

    def links(node):
        return chars(node) if node.tag == "a" else sum(links(c) for c in node.children)

    for _ in range(60):
        root = html_text.Node("body", None)
        build(grow(5), root)
        nodes = html_text.in_order(root)
        html_text.measure(nodes)
        of_body = links(root) / max(1, chars(root))
        for node in nodes:
            c, t, lc = chars(node), len(under(node)), links(node)
            lt = sum(n.tag == "a" for n in [node, *under(node)])
            assert (node.chars, node.tags, node.links, node.link_tags) == (c, t, lc, lt)
            if c:
                outer = math.log(math.log(c / max(1, c - lc) * lc + of_body * c + math.e) + 1)
                inner = math.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt)) + 1 + 1e-9)
                assert node.density == pytest.approx(c / max(1, t) * inner / outer)
            else:
                assert node.density == 0
        sums = {id(n): sum(c.density for c in n.children) for n in nodes}
        best, least = html_text.best_container(nodes)
        assert sums[id(best)] == max(sums[id(n)] for n in nodes if n.tag in html_text.CONTAINERS)
        up, path = best, []
        while up is not None:
            path.append(up.density)
            up = up.parent
        assert least == min(path)


@pytest.mark.parametrize("page", ['<a "' * 500_000, '<a x="' * 300_000, "<svg " * 300_000, "<!x" * 300_000, "<div>" * 20_000 + "</section>" * 20_000, "<div class=related-x>a" * 20_000, "<div class=comments>a" * 20_000], ids=["tags", "values", "svg", "declarations", "depth", "doubts", "names"])
def test_long_broken_pages_take_linear_time(page):
    import time

    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 15


def test_nulls_empty_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, None, "t"), (2, "", None), (3, f"<p>{LONG[0]}", "x"), (3, f"<p>{LONG[0]}", "x")], "page_id long, html string, text string")
    assert sorted(r.text for r in html_text.extract_text(rows).collect()) == ["", "", LONG[0], LONG[0]]
    assert html_text.extract_text(rows.limit(0)).isEmpty()
